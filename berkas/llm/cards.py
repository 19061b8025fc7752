"""The card tables in one shape, for the operators that compare records across them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berkas.llm.addresses import FIELDS, parsed
from berkas.llm.names import profiled
from berkas.operators.packed_fields import known_values
from berkas.sources.tables import table


def city_names(spark: SparkSession, folder: str, limit: int = 50_000) -> list[str]:
    """Names of cities and regencies; administrative units, so of bounded number, which is checked."""
    got = [r[0] for r in known_values((table(spark, folder, "ktp_data"), "kota_kabupaten")).limit(limit + 1).collect()]
    if len(got) > limit:
        raise ValueError(f"more than {limit} city names: not a list of administrative units")
    return got


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    """(rec_id, a) of every card with an address, one row per card. The district columns of identity cards fill the
    components that the address itself lacks, and outrank it where they have a value."""
    cities = city_names(spark, folder)
    ktp = table(spark, folder, "ktp_data").where("alamat is not null").select("rec_id", "alamat", "rt_rw", "kel_desa", "kecamatan", "kota_kabupaten").distinct()
    a = ktp.withColumn("a", parsed(F.col("alamat"), cities))
    digits = F.regexp_extract_all(F.translate(F.upper("rt_rw"), "OIL", "011"), F.lit(r"([0-9]{1,3})"), F.lit(1))
    strip0 = lambda c: F.regexp_replace(c, r"^0+(?=[0-9])", "")
    two = F.size(digits) == 2
    own = {
        "rt": F.when(two, strip0(digits[0])),
        "rw": F.when(two, strip0(digits[1])),
        "village": F.regexp_replace(F.upper(F.trim("kel_desa")), r"^(KELURAHAN|KEL\.?|DESA|DS\.?)\s+", ""),
        "district": F.regexp_replace(F.upper(F.trim("kecamatan")), r"^(KECAMATAN|KEC\.?)\s+", ""),
        "city": F.regexp_replace(F.upper(F.trim("kota_kabupaten")), r"^(KABUPATEN|KAB\.?|KOTA|KODYA)\s+", ""),
    }
    merged = F.struct(*[F.coalesce(F.nullif(own[f], F.lit("")), F.col(f"a.{f}")).alias(f) if f in own else F.col(f"a.{f}").alias(f) for f in FIELDS])
    out = a.select("rec_id", merged.alias("a"))
    for name in ("sim_data", "npwp_data"):
        t = table(spark, folder, name).where("alamat is not null").select("rec_id", "alamat").distinct()
        out = out.unionAll(t.select("rec_id", parsed(F.col("alamat"), cities).alias("a")))
    return out


def persons(spark: SparkSession, folder: str) -> DataFrame:
    """(rec_id, p, a) of every card with a name, one row per card; a is null without an address."""
    null = F.lit(None).cast("string")
    ktp = table(spark, folder, "ktp_data").select("rec_id", "nama", "nik", "tempat_tgl_lahir")
    sim = table(spark, folder, "sim_data").select("rec_id", "nama", null.alias("nik"), "tempat_tgl_lahir")
    npwp = table(spark, folder, "npwp_data").select("rec_id", "nama", "nik", null.alias("tempat_tgl_lahir"))
    cards = ktp.unionAll(sim).unionAll(npwp).where("nama is not null").distinct()
    cards = cards.select("rec_id", profiled(F.col("nama"), F.col("nik"), F.col("tempat_tgl_lahir")).alias("p"))
    return cards.join(addresses(spark, folder), "rec_id", "left")
