"""Every typed kind is exact or takes the exception route; payloads invert."""

import random

import numpy as np
import pytest

from tracewright.functions import kinds as K
from tracewright.functions import payloads as P

GOOD = {
    "int_width": ["0", "007", "123456789012345678"], "signed_int": ["0", "-5", "99"], "decimal": ["0.50", "12.034", "007.1"], "hms": ["00:00:00", "23:59:59"], "day_hms": ["1 00:00:01", "007 23:59:59"],
    "month_day_hms": ["02.29 00:00:01", "12.31 23:59:59"], "iso_datetime": ["2024-02-29 12:00:00", "1969-12-31 23:59:59"], "packed_datetime": ["20171223-22:15:29:606", "20171224-0:7:20:4"],
    "syslog": ["Jan  1 00:00:00", "Feb 29 23:59:59", "Dec 31 01:02:03", "Mar 05 01:01:01"], "apache_time": ["[10/Oct/2000:13:55:36 -0700]", "[01/Jan/1970:00:00:00 +0000]"], "colon_duration": ["00:01", "123:59"],
    "hex_width": ["deadbeef", "00FF", "0"], "hex_pair": ["0x1a/0x00B"], "ipv4_width": ["1.2.3.4", "010.001.255.000"], "endpoint": ["10.0.0.1:80", "255.255.255.255:65535"], "byte_phrase": ["10 bytes", "2000 bytes (1.95 KB)"],
    "asctime_year": ["Thu Jan  1 00:00:00 1970", "Sun Feb 29 23:59:59 2024", "Mon Mar 05 01:01:01 1969"], "yy_datetime": ["17/06/09 20:10:40", "70/01/01 00:00:00"], "iso_millis": ["2015-07-29 17:41:41,536", "1969-12-31 23:59:59.001"],
    "scaled_unit": ["16.3 KB", "0.0 B"], "integer_unit": ["512MB", "1GB"], "int_tuple": ["1,2,3"], "affixed_int": ["blk_-123", "blk_9"],
}
ODD = ["", "x", "1234567890123456789012", "00.00.00", "25:61:61", "2023-02-30 00:00:00", "Feb 30x", "aB", "999.1.1.1", "1.2.3.4:00080", "2000 bytes (9.99 KB)", "01,2,3", "blk_007", "-0", "20170230-1:1:1:1", "[32/Foo/2000:00:00:00 +0000]", None]


@pytest.mark.parametrize("kind", K.KINDS, ids=lambda k: k.name)
def test_exact_or_exception(spark, kind):
    rng = random.Random(0)
    noise = ["".join(rng.choice("0123456789:. -/abF") for _ in range(rng.randrange(1, 20))) for _ in range(200)]
    values = GOOD[kind.name] + ODD + noise
    rows = spark.createDataFrame(list(enumerate(values)), "i long, t string")
    coded = K.coded(rows, kind, "t")
    back = {r.i: r for r in K.decoded(coded, kind, "t").collect()}
    for i, v in enumerate(values):
        assert back[i].t == v, v
        assert i >= len(GOOD[kind.name]) or back[i].exception is None, v


def test_payloads_invert(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([[0, 127, 128, 2**62], rng.integers(0, 2**40, 500)])
    assert (P.unvarints(P.varints(v)) == v).all() and P.unvarints(b"").tolist() == []
    s = ["", "é" * 200, "x"]
    assert P.unstrings(P.strings(s)) == s
    f = [True, False, True] * 5
    assert P.flags(f)[0] & 1 == 1 and P.unflags(P.flags(f), 15) == f
    with pytest.raises(ValueError):
        P.unvarints(b"\x80")
    rows = spark.createDataFrame([([1, 300, 5],), ([],)], "v array<long>")
    assert [r[0] for r in rows.select(P.from_varints(P.to_varints("v"))).collect()] == [[1, 300, 5], []]


def test_sums_of_latents_pass_64_bits(spark):
    rows = spark.createDataFrame([("9" * 18,)] * 12, "t string")
    assert [tuple(r) for r in K.measured(rows, {"int_width": "t"}).collect()] == [("int_width", 12, 12, 12 * (10**18 - 1), 0)]
