"""Fields of identity cards, tax cards, licences and receipts from their text.

Each works on the array of lines of a row, without exploding it: no shuffle, whatever the number of documents. Of the lines
of a kind the last one counts. Null and empty texts give null fields; long texts are read whole.

Kept as they are, since results must agree: short keywords match inside words (a line with KARTU counts as RT); a title line
of a licence names class A if it holds the letter; a header line may be taken for the licence number until a numbered line
comes; all digits of a line make up an amount. Different on purpose: values are cut by patterns on the line itself, so
letters whose upper case is longer do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from berkas.functions.text import digits_folded, let, lines, money, npwp_formatted, trimmed, value_after, value_after_key

# Keywords of identity cards in the order in which they are tried: field, keywords, key before the value.
KTP_RULES = [
    ("provinsi", ["PROVINSI"], "PROVINSI"),
    ("kota_kabupaten", ["KOTA", "KABUPATEN"], None),
    ("nik", ["NIK"], "NIK"),
    ("nama", ["NAMA"], "NAMA"),
    ("tempat_tgl_lahir", ["TEMPAT", "LAHIR"], "LAHIR"),
    ("jenis_kelamin", ["KELAMIN"], "KELAMIN"),
    ("alamat", ["ALAMAT"], "ALAMAT"),
    ("rt_rw", ["RT", "RW"], "RW"),
    ("kel_desa", ["KEL", "DESA"], "DESA"),
    ("kecamatan", ["KECAMATAN"], "KECAMATAN"),
    ("agama", ["AGAMA"], "AGAMA"),
    ("status_perkawinan", ["STATUS", "PERKAWINAN"], "PERKAWINAN"),
    ("pekerjaan", ["PEKERJAAN"], "PEKERJAAN"),
    ("kewarganegaraan", ["KEWARGANEGARAAN"], "KEWARGANEGARAAN"),
    ("berlaku_hingga", ["BERLAKU"], "BERLAKU HINGGA"),
]
KTP_FIELDS = ["provinsi", "kota_kabupaten", "nik", "nama", "tempat_tgl_lahir", "jenis_kelamin", "golongan_darah", "alamat", "rt_rw", "kel_desa", "kecamatan", "agama", "status_perkawinan", "pekerjaan", "kewarganegaraan", "berlaku_hingga"]
NPWP_FIELDS = ["npwp", "npwp_raw", "nama", "nik", "alamat", "kpp", "terdaftar"]
SIM_FIELDS = ["nomor_sim", "golongan", "nama", "tempat_tgl_lahir", "jenis_kelamin", "alamat", "pekerjaan", "berlaku_hingga"]
RECEIPT_FIELDS = ["merchant_name", "receipt_date", "invoice_number", "subtotal", "tax", "discount", "total", "currency"]
SIM_CLASSES = ["C II", "C I", "B II", "B I", "A", "C", "D"]


def _has(up: Column, words: list[str]) -> Column:
    out = F.contains(up, F.lit(words[0]))
    for w in words[1:]:
        out = out | F.contains(up, F.lit(w))
    return out


def _last(arr: Column, test) -> Column:
    """The last element for which test holds."""
    return F.try_element_at(F.filter(arr, test), F.lit(-1))


def ktp_branch(line: Column, at: Column) -> Column:
    """The rule that takes a line, null if none does."""
    up = F.upper(line)
    out = F.when((at <= 3) & (F.length(digits_folded(line)) == 16), "nik_line")
    for name, words, _ in reversed(KTP_RULES):
        out = F.when(_has(up, words), name).otherwise(out)
    return out


def ktp(text: Column) -> Column:
    """Struct of the 16 fields of an identity card."""
    return ktp_from_lines(lines(text))


def ktp_from_lines(ls: Column) -> Column:
    return let(F.filter(F.transform(ls, lambda x, i: F.struct(ktp_branch(x, i).alias("k"), x.alias("x"), i.alias("i"))), lambda t: t["k"].isNotNull()), _ktp_fields)


def _ktp_fields(tagged: Column) -> Column:
    key = {name: k for name, _, k in KTP_RULES}

    def value(name: str) -> Column:
        return value_after(_last(tagged, lambda t: t["k"] == name)["x"], key[name])

    out = {f: value(f) for f in KTP_FIELDS if key.get(f)}
    town = _last(tagged, lambda t: t["k"] == "kota_kabupaten")["x"]
    out["kota_kabupaten"] = F.when(_has(F.upper(town), ["KOTA"]), value_after(town, "KOTA")).otherwise(value_after(town, "KABUPATEN"))
    # numbers: the last labelled one with digits, else the first bare one before any other
    digits = F.filter(F.transform(F.filter(tagged, lambda t: t["k"] == "nik"), lambda t: digits_folded(value_after(t["x"], "NIK"))), lambda d: d != "")
    bare = F.try_element_at(F.filter(tagged, lambda t: t["k"] == "nik_line"), F.lit(1))["x"]
    out["nik"] = F.coalesce(F.substring(F.try_element_at(digits, F.lit(-1)), 1, 16), digits_folded(bare))
    sex_line = _last(tagged, lambda t: t["k"] == "jenis_kelamin")["x"]
    sex = value_after(sex_line, "KELAMIN")
    out["jenis_kelamin"] = F.when(_has(F.upper(sex), ["LAKI"]), "LAKI-LAKI").when(_has(F.upper(sex), ["PEREMPUAN"]), "PEREMPUAN").otherwise(sex)
    blood = _last(tagged, lambda t: (t["k"] == "jenis_kelamin") & _has(F.upper(t["x"]), ["DARAH"]))["x"]
    out["golongan_darah"] = F.regexp_replace(F.regexp_replace(blood, r"(?isU)^.*?DARAH", ""), r"(?U)^[:\-\s]+|[:\-\s]+$", "")
    nation = out["kewarganegaraan"]
    out["kewarganegaraan"] = F.when(_has(F.upper(nation), ["WNI"]), "WNI").otherwise(nation)
    return F.struct(*[out[f].alias(f) for f in KTP_FIELDS])


def nik_valid(nik: Column) -> Column:
    return F.coalesce(nik.rlike("^[0-9]{16}$"), F.lit(False))


def npwp(text: Column) -> Column:
    """Struct of the 7 fields of a tax card."""
    return npwp_from_lines(lines(text))


def npwp_from_lines(ls: Column) -> Column:
    return let(ls, _npwp_lines)


def _npwp_lines(ls: Column) -> Column:
    up = F.upper
    label = lambda x: _has(up(x), ["NPWP", "NOMOR POKOK"])
    number = lambda x: digits_folded(value_after_key(x, "NPWP"))
    bare = lambda x: F.length(digits_folded(x)).isin(15, 16)
    first = F.transform(ls, lambda x, i: F.when((label(x) & (number(x) != "")) | (~label(x) & bare(x)), i))
    return let(F.array_min(first), lambda at: _npwp_tagged(ls, at, label, number, bare))  # the line that first sets the number


def _npwp_tagged(ls: Column, first: Column, label, number, bare) -> Column:
    up = F.upper
    kind = lambda x, i: (
        F.when(label(x), "npwp").when(bare(x) & (i == first), "bare").when(_has(up(x), ["NAMA"]), "nama").when(_has(up(x), ["NIK"]), "nik").when(_has(up(x), ["ALAMAT"]), "alamat").when(_has(up(x), ["KPP"]), "kpp").when(_has(up(x), ["TERDAFTAR"]), "terdaftar")
    )
    tagged = F.filter(F.transform(ls, lambda x, i: F.struct(kind(x, i).alias("k"), x.alias("x"), i.alias("i"))), lambda t: t["k"].isNotNull())
    return let(tagged, lambda t: _npwp_fields(ls, t, number))


def _npwp_fields(ls: Column, tagged: Column, number) -> Column:
    up = F.upper
    of = lambda k: _last(tagged, lambda t: t["k"] == k)
    numbers = F.filter(F.transform(F.filter(tagged, lambda t: t["k"] == "npwp"), lambda t: number(t["x"])), lambda d: d != "")
    digits = F.coalesce(F.substring(F.try_element_at(numbers, F.lit(-1)), 1, 16), digits_folded(of("bare")["x"]))
    last = F.try_element_at(numbers, F.lit(-1))
    digits = F.when(F.length(last) < 15, last).otherwise(digits)
    niks = F.filter(F.transform(F.filter(tagged, lambda t: t["k"] == "nik"), lambda t: digits_folded(value_after_key(t["x"], "NIK"))), lambda d: d != "")
    a = of("alamat")
    nxt = F.try_element_at(ls, a["i"] + 2)
    more = nxt.isNotNull() & ~_has(up(nxt), ["KPP", "TERDAFTAR", "NPWP", "NIK"])
    alamat = value_after_key(a["x"], "ALAMAT")
    return F.struct(
        npwp_formatted(digits).alias("npwp"), digits.alias("npwp_raw"), value_after_key(of("nama")["x"], "NAMA").alias("nama"), F.substring(F.try_element_at(niks, F.lit(-1)), 1, 16).alias("nik"),
        F.when(F.coalesce(more, F.lit(False)), F.concat(alamat, F.lit(" "), trimmed(nxt))).otherwise(alamat).alias("alamat"), value_after_key(of("kpp")["x"], "KPP").alias("kpp"), value_after_key(of("terdaftar")["x"], "TERDAFTAR").alias("terdaftar"),
    )


def npwp_valid(raw: Column) -> Column:
    return F.coalesce(raw.rlike("^[0-9]{15,16}$"), F.lit(False))


def sim(text: Column) -> Column:
    """Struct of the 8 fields of a driving licence."""
    return sim_from_lines(lines(text))


def sim_from_lines(ls: Column) -> Column:
    return let(ls, _sim_lines)


def _sim_lines(ls: Column) -> Column:
    up = F.upper
    cls = F.lit(None).cast("string")

    def licence_class(x):
        out = cls
        for c in reversed(SIM_CLASSES):
            out = F.when(_has(up(x), [c]), c).otherwise(out)
        return F.when(_has(up(x), ["SURAT IZIN MENGEMUDI", "SIM "]) | F.startswith(up(x), F.lit("SIM")), out)

    numbered = lambda x: _has(up(x), ["NO"]) & _has(up(x), ["SIM", "NOMOR"])
    starts = lambda x, n: F.startswith(up(x), F.lit(f"{n}.")) | F.startswith(up(x), F.lit(f"{n} "))
    name = lambda x: starts(x, 1) | (_has(up(x), ["NAMA"]) & ~_has(up(x), ["KEPALA"]))
    born = lambda x: starts(x, 2) | _has(up(x), ["LAHIR"])
    lives = lambda x: starts(x, 4) | _has(up(x), ["ALAMAT"])
    work = lambda x: starts(x, 5) | _has(up(x), ["PEKERJAAN"])
    until = lambda x: _has(up(x), ["BERLAKU", "S/D", "HINGGA"])
    kind = lambda x: F.when(numbered(x), "no").when(name(x), "nama").when(born(x), "lahir").when(lives(x), "alamat").when(work(x), "pekerjaan").when(until(x), "berlaku")
    tagged = F.transform(ls, lambda x, i: F.struct(kind(x).alias("k"), x.alias("x"), i.alias("i")))
    return let(tagged, lambda t: _sim_fields(ls, t, licence_class))


def _sim_fields(ls: Column, tagged: Column, licence_class) -> Column:
    up = F.upper

    def value(x, key):
        return F.when(_has(up(x), [key]), value_after_key(x, key)).otherwise(trimmed(F.substring(x, 3, 1_000_000)))

    def last_value(k, key):
        vs = F.transform(F.filter(tagged, lambda t: t["k"] == k), lambda t: value(t["x"], key))
        return F.try_element_at(F.filter(vs, lambda v: v != ""), F.lit(-1))

    numbers = F.filter(F.transform(F.filter(tagged, lambda t: t["k"] == "no"), lambda t: digits_folded(value_after_key(t["x"], "SIM"))), lambda d: F.length(d) >= 8)
    # a bare line of 12 to 16 digits counts only while no number is set
    loose = F.filter(F.transform(F.filter(tagged, lambda t: F.coalesce(t["k"], F.lit("")) != "no"), lambda t: digits_folded(t["x"])), lambda d: F.length(d).between(12, 16))
    classes = F.filter(F.transform(ls, licence_class), lambda c: c.isNotNull())
    sexed = F.filter(tagged, lambda t: ~F.coalesce(t["k"], F.lit("")).isin("no", "nama", "lahir") & _has(up(t["x"]), ["PRIA", "LAKI", "WANITA", "PEREMPUAN"]))
    sex = F.try_element_at(sexed, F.lit(-1))["x"]
    a = _last(tagged, lambda t: t["k"] == "alamat")
    nxt = F.try_element_at(ls, a["i"] + 2)
    more = nxt.isNotNull() & ~F.startswith(up(nxt), F.lit("5.")) & ~_has(up(nxt), ["PEKERJAAN", "BERLAKU"])
    alamat = value(a["x"], "ALAMAT")

    def end(x):
        v = value_after_key(x, "BERLAKU")
        cut = F.when(_has(up(v), ["S/D"]), F.regexp_replace(v, r"(?is)^.*?S/D", "")).when(_has(up(v), ["HINGGA"]), F.regexp_replace(v, r"(?is)^.*?HINGGA", "")).otherwise(v)
        return trimmed(F.regexp_replace(cut, r"(?U)^[:=\-\s]+", ""))

    ends = F.filter(F.transform(F.filter(tagged, lambda t: t["k"] == "berlaku"), lambda t: end(t["x"])), lambda v: v != "")
    return F.struct(
        F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.try_element_at(loose, F.lit(1))).alias("nomor_sim"), F.try_element_at(classes, F.lit(-1)).alias("golongan"),
        last_value("nama", "NAMA").alias("nama"), last_value("lahir", "LAHIR").alias("tempat_tgl_lahir"),
        F.when(_has(up(sex), ["PRIA", "LAKI"]), "LAKI-LAKI").when(sex.isNotNull(), "PEREMPUAN").alias("jenis_kelamin"),
        F.when(F.coalesce(more, F.lit(False)), F.concat(alamat, F.lit(" "), trimmed(nxt))).otherwise(alamat).alias("alamat"),
        last_value("pekerjaan", "PEKERJAAN").alias("pekerjaan"), F.try_element_at(ends, F.lit(-1)).alias("berlaku_hingga"),
    )


def sim_valid(number: Column) -> Column:
    return F.coalesce(number.rlike("^[0-9]{8,}$"), F.lit(False))


def receipt(text: Column) -> Column:
    """Struct of the fields of a receipt; `items` is always empty."""
    return receipt_from_lines(lines(text))


def receipt_branch(line: Column) -> Column:
    up = F.upper(line)
    return (
        F.when(_has(up, ["TOTAL"]) & ~_has(up, ["SUB"]), "total").when(_has(up, ["SUBTOTAL", "SUB TOTAL"]), "subtotal").when(_has(up, ["TAX", "PPN", "PAJAK"]), "tax")
        .when(_has(up, ["DISKON", "DISCOUNT"]), "discount").when(_has(up, ["INVOICE", "NO:", "STRUK:"]), "invoice_number").when(_has(up, ["TANGGAL", "DATE"]), "receipt_date")
    )


def receipt_from_lines(ls: Column) -> Column:
    return let(ls, lambda x: let(F.filter(F.transform(x, lambda y: F.struct(receipt_branch(y).alias("k"), y.alias("x"))), lambda t: t["k"].isNotNull()), lambda t: _receipt_fields(x, t)))


def _receipt_fields(ls: Column, tagged: Column) -> Column:
    first = F.try_element_at(ls, F.lit(1))

    def amount(k):
        return F.try_element_at(F.filter(F.transform(F.filter(tagged, lambda t: t["k"] == k), lambda t: money(t["x"])), lambda v: v.isNotNull()), F.lit(-1))

    def after_colon(k):
        got = F.filter(tagged, lambda t: (t["k"] == k) & F.contains(t["x"], F.lit(":")))
        return trimmed(F.regexp_replace(F.try_element_at(got, F.lit(-1))["x"], r"(?s)^[^:]*:", ""))

    money_of = lambda x: F.when(_has(F.upper(x), ["RP", "IDR"]), "IDR").when(_has(F.upper(x), ["$", "USD"]), "USD")
    currency = F.try_element_at(F.filter(F.transform(ls, money_of), lambda c: c.isNotNull()), F.lit(-1))
    items = F.array().cast("array<struct<name:string,quantity:float,price:double>>")
    return F.struct(
        F.when(~_has(F.upper(first), ["TOTAL", "INVOICE", "RECEIPT"]), trimmed(first)).alias("merchant_name"), after_colon("receipt_date").alias("receipt_date"), after_colon("invoice_number").alias("invoice_number"),
        amount("subtotal").alias("subtotal"), amount("tax").alias("tax"), amount("discount").alias("discount"), amount("total").alias("total"), currency.alias("currency"), items.alias("items"),
    )


def key_value(line: Column) -> Column:
    """Struct (key, value) of a line, cut at its first colon or else its first equals sign where both sides hold text; null
    where neither does."""
    t = trimmed(line)

    def cut(sign):
        at = F.instr(t, sign)
        k, v = trimmed(F.substring(t, F.lit(1), at - 1)), trimmed(F.substring(t, at + 1, F.length(t)))
        return F.when((at > 0) & (k != "") & (v != ""), F.struct(k.alias("key"), v.alias("value")))

    return F.coalesce(cut(":"), cut("="))
