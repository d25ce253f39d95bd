import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import hashing as H
from tallyframe.functions import sizing as S


def test_fixed_values():
    assert H.murmur32(b"hashthis") == -1974946086
    assert H.murmur64(b"hashthis") == -8896273065425798843
    want = [0xC4C20DD5, 0x3AB04CC3, 0xEBE874A3, 0x0E770EF3, 0xEC321498, 0x73845E86, 0x8A2DB728, 0x03C313BB, 0xFE5B9199, 0x95965125, 0xCBC4E7C2]
    s = "hello world"
    assert [H.lookup3([ord(c) for c in s[: i + 1]], i * 12345) & H.W32 for i in range(11)] == want
    assert [H.lookup3_text(s[: i + 1], i * 12345 + 4 * (i + 1)) & H.W32 for i in range(11)] == want
    assert H.lookup3_text64("abc") & H.W32 == H.lookup3_text64("abc", -1) & H.W32
    assert H.java_random_ints(1, 3) == [1569548985, 215764588, 880641847]
    assert H.hash_value(None) == 0 and H.hash_value("5") != H.hash_value(5)
    assert H.hash_value(1.5) == H.murmur_long_value(int(np.float64(1.5).view(np.int64)))


def test_columns_equal_values(spark):
    ints = [0, 1, -1, 2**31, -(2**31), 2**63 - 1, -(2**63), *range(-50, 50)]
    got = spark.createDataFrame([(i,) for i in ints], "x long").select("x", F.expr(H.murmur_long("x")).alias("h"), F.expr(H.linear_bucket("x", 1569548985, 1000)).alias("b")).collect()
    for r in got:
        assert r.h == H.murmur_long_value(r.x) & H.W32
        full = 1569548985 * r.x & H.W64
        full = full - (full >> 63 << 64)
        assert r.b == ((full + (full >> 32)) & 0x7FFFFFFF) % 1000
    texts = ["", "a", "abc", "hashthis", "é日\U0001f600", "x" * 40, None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    names = {"murmur32": lambda t: H.murmur32(t.encode()), "murmur64": lambda t: H.murmur64(t.encode()), "lookup3_text": H.lookup3_text, "lookup3_text64": H.lookup3_text64}
    for name, f in names.items():
        assert {r.s: r.h for r in df.select("s", H.bytes_hash(F.col("s"), name).alias("h")).collect()} == {t: 0 if t is None else f(t) for t in texts}


def test_buckets_of_two_hashes(spark):
    one, two = 4_000_000_000, 3_999_999_999
    got = spark.range(1).select(*(F.expr(b).alias(f"b{i}") for i, b in enumerate(H.buckets(f"{one}L", f"{two}L", 5, 1000)))).first()
    assert list(got) == [abs(H._signed(one + i * two & H.W32, 32)) % 1000 for i in range(5)]
    assert len(set(H.bucket_values("key", 5, 10**6))) == 5 and H.bucket_values(b"\xfe\xff\x00k", 3, 99) == H.bucket_values("k", 3, 99)


ONE_PERCENT = {1: 630, 99: 630, 100: 630, 101: 630, 3375: 759, 9999: 995, 10000: 995, 10001: 996, 305028: 7501, 1000000: 19272, 1250000: 23027, 5000000: 74962, 5500000: 81372, 9500000: 131030, 10000000: 137073, 10000001: 137073, 30000000: 355055, 50000000: 573038, 75000000: 822207, 100000000: 1071377, 110000000: 1167722, 120000000: 1264067, 240000000: 2500000}


def test_sizes():
    assert {n: S.linear_counting_bytes(n) for n in ONE_PERCENT} == ONE_PERCENT
    cases = [(0.01, 100, 630), (0.01, 3375, 759), (0.1, 100, 10), (0.1, 1000, 34), (0.1, 10000, 214), (0.1, 100000, 1593), (0.1, 1000000, 12610), (0.1, 10000000, 103977), (0.1, 100000000, 882720)]
    assert [S.linear_counting_bytes_for(e, n) for e, n, _ in cases] == [b for *_, b in cases]
    assert (S.CountMin.within(1e-4, 0.99).depth, S.CountMin.within(1e-4, 0.99).width) == (7, 20000)
    assert S.Bloom.within(1_000_000, 0.01).bits == 10_000_064
    assert S.hll_bits_for_rsd(0.01) == 13 and S.adaptive_choice(10**7) == ("adaptive", 16)
    for bad in (lambda: S.linear_counting_bytes(0), lambda: S.linear_counting_bytes_for(2, 5), lambda: S.check_bits(3), lambda: S.CountMin.of(0, 5)):
        with pytest.raises(ValueError):
            bad()
    assert [round(S.loglog_alpha(k), 6) for k in (1, 2, 3, 13)] == [0.445679, 1.248064, 2.839126, 3251.986254]
