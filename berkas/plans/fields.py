"""Queries on typed fields in text, over all documents, with SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berkas.functions import text as tx
from berkas.operators import cards, entities
from berkas.sources.tables import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", "text")


def _fields(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("doc_id", *[F.col(f"f.{n}").alias(n) for n in names])


def extract_ktp(spark: SparkSession, folder: str) -> DataFrame:
    x = _fields(_docs(spark, folder).withColumn("f", cards.ktp(F.col("text"))), cards.KTP_FIELDS)
    return x.withColumn("valid", cards.nik_valid(F.col("nik")))


def extract_npwp(spark: SparkSession, folder: str) -> DataFrame:
    x = _fields(_docs(spark, folder).withColumn("f", cards.npwp(F.col("text"))), cards.NPWP_FIELDS)
    return x.withColumn("valid", cards.npwp_valid(F.col("npwp_raw")))


def extract_sim(spark: SparkSession, folder: str) -> DataFrame:
    x = _fields(_docs(spark, folder).withColumn("f", cards.sim(F.col("text"))), cards.SIM_FIELDS)
    return x.withColumn("valid", cards.sim_valid(F.col("nomor_sim")))


def extract_receipt(spark: SparkSession, folder: str) -> DataFrame:
    return _fields(_docs(spark, folder).withColumn("f", cards.receipt(F.col("text"))), cards.RECEIPT_FIELDS)


def key_values(spark: SparkSession, folder: str) -> DataFrame:
    x = _docs(spark, folder).select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line_no", "line")).withColumn("kv", cards.key_value(F.col("line")))
    return x.where("kv is not null").select("doc_id", "line_no", "kv.key", "kv.value")


def _entity(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        f = getattr(entities, name)
        return _docs(spark, folder).select("doc_id", F.posexplode(f(F.col("text"))).alias("i", "value"))

    run.__name__ = f"entities_{name}"
    run.__doc__ = f"{name} of all documents, in order of first sight."
    return run


def entities_empty(spark: SparkSession, folder: str) -> DataFrame:
    empty = tx.let(entities.entities(F.col("text")), entities.none_found)
    return _docs(spark, folder).groupBy(empty.alias("is_empty")).agg(F.count("*").alias("n"))


def digit_fold(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ktp_data").select("rec_id", tx.digits_folded(F.col("nik")).alias("digits"), cards.nik_valid(F.col("nik")).alias("valid")).distinct()


def npwp_format(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "npwp_data").select("rec_id", tx.npwp_formatted(tx.digits_folded(F.col("npwp_raw"))).alias("formatted")).distinct()


def currency_parse(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "table_cells").select("cell_id", "text").distinct()
    return d.select("cell_id", tx.money(F.col("text")).alias("amount"))


def normalized_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ocr_text").select("ocr_id", tx.normalized(F.col("text")).alias("normalized")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        extract_ktp, extract_npwp, extract_sim, extract_receipt, key_values, *[_entity(n) for n in ("emails", "urls", "niks", "amounts", "dates", "vehicle_plates", "phone_numbers")], entities_empty, digit_fold,
        npwp_format, currency_parse, normalized_lines,
    )
}

_WS = "[ \\t\\r\\n\\x0b\\f]"
_LINES = f"""d as (select doc_id, text from documents where text is not null),
l0 as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as p from d),
l1 as (select doc_id, p, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') as line from l0),
l as (select doc_id, line, upper(line) as u, row_number() over (partition by doc_id order by p) - 1 as i, lead(line) over (partition by doc_id order by p) as nx from l1 where line <> '')"""
_FOLD = "regexp_replace(translate({}, '" + tx.FOLD_FROM + "', '" + tx.FOLD_TO + "'), '[^0-9]', '', 'g')"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _after(x: str, key: str) -> str:
    return _trim(f"regexp_replace({x}, '(?is)^.*?{key}[:=\\-\\s]*', '')")


def _value(x: str, key: str) -> str:
    return f"case when contains(upper({x}), '{key}') then {_after(x, key)} when contains({x}, ':') then {_trim(f'''regexp_replace({x}, '(?s)^[^:]*:', '')''')} else {_trim(x)} end"


def _value2(x: str, key: str) -> str:
    lead = _trim(f"regexp_replace({x}, '^[:=\\-\\s]+', '')")
    return f"case when contains(upper({x}), '{key}') then {_after(x, key)} else {lead} end"


def _has(words: list[str], u: str = "u") -> str:
    return "(" + " or ".join(f"contains({u}, '{w}')" for w in words) + ")"


def _ktp_sql() -> str:
    branch = "case " + " ".join(f"when {_has(w)} then '{n}'" for n, w, _ in cards.KTP_RULES) + f" when i <= 3 and length({_FOLD.format('line')}) = 16 then 'nik_line' end"
    vals = []
    for n, _, key in cards.KTP_RULES:
        if n in ("kota_kabupaten", "nik", "jenis_kelamin", "kewarganegaraan"):
            continue
        vals.append(f"arg_max({_value('line', key)}, i) filter (where k = '{n}') as {n}")
    sex = _value("line", "KELAMIN")
    nation = _value("line", "KEWARGANEGARAAN")
    nik = _FOLD.format(_value("line", "NIK"))
    vals += [
        f"arg_max(case when contains(u, 'KOTA') then {_value('line', 'KOTA')} else {_value('line', 'KABUPATEN')} end, i) filter (where k = 'kota_kabupaten') as kota_kabupaten",
        f"coalesce(substr(arg_max({nik}, i) filter (where k = 'nik' and {nik} <> ''), 1, 16), arg_min({_FOLD.format('line')}, i) filter (where k = 'nik_line')) as nik",
        f"arg_max(case when contains(upper({sex}), 'LAKI') then 'LAKI-LAKI' when contains(upper({sex}), 'PEREMPUAN') then 'PEREMPUAN' else {sex} end, i) filter (where k = 'jenis_kelamin') as jenis_kelamin",
        "arg_max(regexp_replace(regexp_replace(line, '(?is)^.*?DARAH', ''), '^[:\\-\\s]+|[:\\-\\s]+$', '', 'g'), i) filter (where k = 'jenis_kelamin' and contains(u, 'DARAH')) as golongan_darah",
        f"arg_max(case when contains(upper({nation}), 'WNI') then 'WNI' else {nation} end, i) filter (where k = 'kewarganegaraan') as kewarganegaraan",
    ]
    return f"with {_LINES}, t as (select *, {branch} as k from l), a as (select doc_id, {', '.join(vals)} from t group by doc_id) select d.doc_id, {', '.join(cards.KTP_FIELDS)}, coalesce(regexp_full_match(nik, '[0-9]{{16}}'), false) as valid from d left join a on d.doc_id = a.doc_id"


def _npwp_sql() -> str:
    num = _FOLD.format(_value2("line", "NPWP"))
    nik = _FOLD.format(_value2("line", "NIK"))
    return f"""with {_LINES}, n as (select *, {_has(['NPWP', 'NOMOR POKOK'])} as lab, {num} as dn, {_FOLD.format('line')} as dl from l),
f as (select doc_id, min(i) as first from n where (lab and dn <> '') or (not lab and length(dl) in (15, 16)) group by doc_id),
t as (select n.*, case when lab then 'npwp' when length(dl) in (15, 16) and i = first then 'bare' when contains(u, 'NAMA') then 'nama' when contains(u, 'NIK') then 'nik' when contains(u, 'ALAMAT') then 'alamat' when contains(u, 'KPP') then 'kpp' when contains(u, 'TERDAFTAR') then 'terdaftar' end as k from n left join f on n.doc_id = f.doc_id),
a as (select doc_id, coalesce(substr(arg_max(dn, i) filter (where k = 'npwp' and dn <> ''), 1, 16), arg_max(dl, i) filter (where k = 'bare')) as npwp_raw, arg_max({_value2('line', 'NAMA')}, i) filter (where k = 'nama') as nama,
substr(arg_max({nik}, i) filter (where k = 'nik' and {nik} <> ''), 1, 16) as nik,
arg_max({_value2('line', 'ALAMAT')} || case when nx is not null and not {_has(['KPP', 'TERDAFTAR', 'NPWP', 'NIK'], 'upper(nx)')} then ' ' || nx else '' end, i) filter (where k = 'alamat') as alamat,
arg_max({_value2('line', 'KPP')}, i) filter (where k = 'kpp') as kpp, arg_max({_value2('line', 'TERDAFTAR')}, i) filter (where k = 'terdaftar') as terdaftar from t group by doc_id)
select d.doc_id, case when length(npwp_raw) = 15 then regexp_replace(npwp_raw, '^(..)(...)(...)(.)(...)(...)$', '\\1.\\2.\\3.\\4-\\5.\\6') else npwp_raw end as npwp, npwp_raw, nama, nik, alamat, kpp, terdaftar, coalesce(regexp_full_match(npwp_raw, '[0-9]{{15,16}}'), false) as valid from d left join a on d.doc_id = a.doc_id"""


def _sim_sql() -> str:
    num = _FOLD.format(_value2("line", "SIM"))
    rest = _trim("substr(line, 3)")
    val = lambda key: f"case when contains(u, '{key}') then {_value2('line', key)} else {rest} end"
    cls = "case " + " ".join(f"when contains(u, '{c}') then '{c}'" for c in cards.SIM_CLASSES) + " end"
    until = _value2("line", "BERLAKU")
    cut = f"case when contains(upper({until}), 'S/D') then regexp_replace({until}, '(?is)^.*?S/D', '') when contains(upper({until}), 'HINGGA') then regexp_replace({until}, '(?is)^.*?HINGGA', '') else {until} end"
    end = _trim(f"regexp_replace({cut}, '^[:=\\-\\s]+', '')")
    st = lambda n: f"(u like '{n}.%' or u like '{n} %')"
    return f"""with {_LINES}, t as (select *, case when contains(u, 'NO') and (contains(u, 'SIM') or contains(u, 'NOMOR')) then 'no' when {st(1)} or (contains(u, 'NAMA') and not contains(u, 'KEPALA')) then 'nama'
when {st(2)} or contains(u, 'LAHIR') then 'lahir' when {st(4)} or contains(u, 'ALAMAT') then 'alamat' when {st(5)} or contains(u, 'PEKERJAAN') then 'pekerjaan' when {_has(['BERLAKU', 'S/D', 'HINGGA'])} then 'berlaku' end as k from l),
v as (select *, {num} as dn, {_FOLD.format('line')} as dl, {val('NAMA')} as v1, {val('LAHIR')} as v2, {val('PEKERJAAN')} as v5, {end} as v6, case when {_has(['SURAT IZIN MENGEMUDI', 'SIM '])} or u like 'SIM%' then {cls} end as c from t),
a as (select doc_id, coalesce(arg_max(dn, i) filter (where k = 'no' and length(dn) >= 8), arg_min(dl, i) filter (where coalesce(k, '') <> 'no' and length(dl) between 12 and 16)) as nomor_sim, arg_max(c, i) filter (where c is not null) as golongan,
arg_max(v1, i) filter (where k = 'nama' and v1 <> '') as nama, arg_max(v2, i) filter (where k = 'lahir' and v2 <> '') as tempat_tgl_lahir,
arg_max(case when {_has(['PRIA', 'LAKI'])} then 'LAKI-LAKI' else 'PEREMPUAN' end, i) filter (where coalesce(k, '') not in ('no', 'nama', 'lahir') and {_has(['PRIA', 'LAKI', 'WANITA', 'PEREMPUAN'])}) as jenis_kelamin,
arg_max({val('ALAMAT')} || case when nx is not null and not (upper(nx) like '5.%') and not {_has(['PEKERJAAN', 'BERLAKU'], 'upper(nx)')} then ' ' || nx else '' end, i) filter (where k = 'alamat') as alamat,
arg_max(v5, i) filter (where k = 'pekerjaan' and v5 <> '') as pekerjaan, arg_max(v6, i) filter (where k = 'berlaku' and v6 <> '') as berlaku_hingga from v group by doc_id)
select d.doc_id, {', '.join(cards.SIM_FIELDS)}, coalesce(regexp_full_match(nomor_sim, '[0-9]{{8,}}'), false) as valid from d left join a on d.doc_id = a.doc_id"""


def _money(x: str) -> str:
    c = f"regexp_replace({x}, '[^0-9.,]', '', 'g')"
    ac, ad = f"instr(reverse({c}), ',')", f"instr(reverse({c}), '.')"
    return f"""try_cast(case when {ac} > 0 and {ad} > 0 then case when {ac} < {ad} then replace(replace({c}, '.', ''), ',', '.') else replace({c}, ',', '') end
when {ac} > 0 then case when {ac} = 3 then replace({c}, ',', '.') else replace({c}, ',', '') end when {ad} > 3 then replace({c}, '.', '') else {c} end as double)"""


def _receipt_sql() -> str:
    colon = _trim("regexp_replace(line, '(?s)^[^:]*:', '')")
    return f"""with {_LINES}, t as (select *, {_money('line')} as m, case when contains(u, 'TOTAL') and not contains(u, 'SUB') then 'total' when {_has(['SUBTOTAL', 'SUB TOTAL'])} then 'subtotal' when {_has(['TAX', 'PPN', 'PAJAK'])} then 'tax'
when {_has(['DISKON', 'DISCOUNT'])} then 'discount' when {_has(['INVOICE', 'NO:', 'STRUK:'])} then 'invoice' when {_has(['TANGGAL', 'DATE'])} then 'date' end as k, case when {_has(['RP', 'IDR'])} then 'IDR' when {_has(['$', 'USD'])} then 'USD' end as cur from l),
a as (select doc_id, max(case when i = 0 and not {_has(['TOTAL', 'INVOICE', 'RECEIPT'])} then line end) as merchant_name, arg_max({colon}, i) filter (where k = 'date' and contains(line, ':')) as receipt_date, arg_max({colon}, i) filter (where k = 'invoice' and contains(line, ':')) as invoice_number,
{', '.join(f"arg_max(m, i) filter (where k = '{f}' and m is not null) as {f}" for f in ('subtotal', 'tax', 'discount', 'total'))}, arg_max(cur, i) filter (where cur is not null) as currency from t group by doc_id)
select d.doc_id, {', '.join(cards.RECEIPT_FIELDS)} from d left join a on d.doc_id = a.doc_id"""


_W = f"""{_LINES}, w0 as (select doc_id, i, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') as ws from l),
w as (select doc_id, i, unnest(ws) as word, generate_subscripts(ws, 1) as p from w0), s as (select *, lead(word) over x as w2, lead(word, 2) over x as w3 from w window x as (partition by doc_id, i order by p))"""


def _ranked(found: str, order: str = "i, p") -> str:
    """Distinct values of `found` (doc_id, value, order columns) in order of first sight."""
    return f"{found}, r as (select doc_id, value, min(row({order})) as o from f group by all) select doc_id, cast(row_number() over (partition by doc_id order by o) - 1 as integer) as i, value from r"


_STRIP = "regexp_replace({}, '^[,.;:()\\[\\]]+|[,.;:()\\[\\]]+$', '', 'g')"
_STRIP2 = "regexp_replace({}, '^[,.;:()]+|[,.;:()]+$', '', 'g')"
_DIG = "regexp_replace({}, '^[^0-9]+|[^0-9]+$', '', 'g')"
SQL = {
    "extract_ktp": _ktp_sql(),
    "extract_npwp": _npwp_sql(),
    "extract_sim": _sim_sql(),
    "extract_receipt": _receipt_sql(),
    "key_values": f"""with {_LINES}, k as (select doc_id, cast(i as integer) as line_no, line, instr(line, ':') as c, instr(line, '=') as e from l),
v as (select doc_id, line_no, {_trim('substr(line, 1, c - 1)')} as k1, {_trim('substr(line, c + 1)')} as v1, {_trim('substr(line, 1, e - 1)')} as k2, {_trim('substr(line, e + 1)')} as v2, c, e from k)
select doc_id, line_no, case when c > 0 and k1 <> '' and v1 <> '' then k1 else k2 end as key, case when c > 0 and k1 <> '' and v1 <> '' then v1 else v2 end as value from v where (c > 0 and k1 <> '' and v1 <> '') or (e > 0 and k2 <> '' and v2 <> '')""",
    "entities_emails": "with " + _ranked(f"{_W}, f as (select doc_id, i, p, {_STRIP.format('word')} as value from w where regexp_full_match({_STRIP.format('word')}, '[^@]+@[^@]*\\.[^@]*') and strlen(regexp_replace({_STRIP.format('word')}, '^.*@', '')) >= 3)"),
    "entities_urls": "with " + _ranked(f"{_W}, f as (select doc_id, i, p, {_STRIP.format('word')} as value from w where regexp_matches({_STRIP.format('word')}, '^(http://|https://|www\\.)'))"),
    "entities_niks": "with " + _ranked(f"{_W}, c as (select doc_id, i, p, regexp_replace(word, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') as t from w), f as (select doc_id, i, p, regexp_replace(t, '[^0-9]', '', 'g') as value from c where length(regexp_replace(t, '[^0-9]', '', 'g')) = 16 and (strlen(t) = 16 or regexp_matches(t, '[-.]')))"),
    "entities_amounts": "with " + _ranked(f"{_W}, f as (select doc_id, i, p, case when upper(word) in ('RP', 'RP.', 'IDR', '$') then case when regexp_matches(w2, '[0-9]') then word || ' ' || w2 end when regexp_matches(upper(word), '^(RP|IDR|\\$)') and regexp_matches(word, '[0-9]') then word end as value from s where value is not null)"),
    "entities_dates": "with " + _ranked(f"""{_W}, f as (select doc_id, i, 0 as kind, p, {_STRIP2.format('word')} as value from w where regexp_full_match({_STRIP2.format('word')}, '([0-9]{{2}}|[0-9]{{4}})(/[0-9]{{2}}/|-[0-9]{{2}}-)([0-9]{{2}}|[0-9]{{4}})')
union all select doc_id, i, 1, p, word || ' ' || w2 || ' ' || w3 from s where regexp_full_match({_DIG.format('word')}, '[0-9]+') and try_cast({_DIG.format('word')} as bigint) between 1 and 31 and regexp_matches(upper(w2), '{'|'.join(entities.MONTHS)}') and strlen({_DIG.format('w3')}) = 4)""", "i, kind, p"),
    "entities_vehicle_plates": "with " + _ranked(f"""{_W}, f as (select doc_id, i, p, upper(word) || ' ' || w2 || ' ' || w3 as value from s where upper(word) in ({', '.join(repr(x) for x in entities.PLATES)}) and length(regexp_replace(w2, '[^0-9]', '', 'g')) between 1 and 4
and length(regexp_replace(w3, '[^A-Za-z]', '', 'g')) between 1 and 3 and strlen(w3) <= 4)"""),
    "entities_phone_numbers": "with recursive " + _ranked(f"""{_W}, t0 as (select doc_id, i, p, {_STRIP2.format('word')} as h, regexp_replace(word, '^[,.;]+|[,.;]+$', '', 'g') as t from w),
t1 as (select *, regexp_full_match(t, '[0-9-]{{3,6}}') as goes from t0), t2 as (select *, coalesce(min(case when not goes then p end) over (partition by doc_id, i order by p rows between 1 following and unbounded following), max(p) over (partition by doc_id, i) + 1) as stop from t1),
hd as (select doc_id, i, p, h, stop from t2 where regexp_matches(h, '^(\\+62|08|628|021)')),
wh as (select hd.doc_id, hd.i, hd.p, hd.stop, hd.h || coalesce(string_agg(' ' || t2.t, '' order by t2.p), '') as value from hd left join t2 on t2.doc_id = hd.doc_id and t2.i = hd.i and t2.p > hd.p and t2.p < hd.stop group by hd.doc_id, hd.i, hd.p, hd.stop, hd.h),
gd as (select * from wh where length(regexp_replace(value, '[^0-9]', '', 'g')) between 10 and 15),
pk as (select doc_id, i, p, stop, value from (select *, row_number() over (partition by doc_id, i order by p) as k from gd) where k = 1
union all select gd.doc_id, gd.i, gd.p, gd.stop, gd.value from (select pk.doc_id, pk.i, min(gd.p) as p from pk join gd on gd.doc_id = pk.doc_id and gd.i = pk.i and gd.p >= pk.stop group by pk.doc_id, pk.i) n join gd on gd.doc_id = n.doc_id and gd.i = n.i and gd.p = n.p),
f as (select doc_id, i, p, value from pk)"""),
    "digit_fold": f"select distinct rec_id, {_FOLD.format('nik')} as digits, coalesce(regexp_full_match(nik, '[0-9]{{16}}'), false) as valid from ktp_data",
    "npwp_format": f"select distinct rec_id, case when length({_FOLD.format('npwp_raw')}) = 15 then regexp_replace({_FOLD.format('npwp_raw')}, '^(..)(...)(...)(.)(...)(...)$', '\\1.\\2.\\3.\\4-\\5.\\6') else {_FOLD.format('npwp_raw')} end as formatted from npwp_data",
    "currency_parse": f"select cell_id, {_money('text')} as amount from (select distinct cell_id, text from table_cells)",
    "normalized_lines": "select distinct ocr_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as normalized from ocr_text",
}
SQL["entities_empty"] = "select doc_id not in (" + " union ".join(f"select doc_id from ({SQL[f'entities_{n}']}) t_{n}" for n in entities.LISTS) + ") as is_empty, count(*) as n from documents where text is not null group by 1"
