"""Byte layouts against fixed vectors."""

import gzip
import io
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from spoolwright import codec
from spoolwright.arrays import MAX_SIZE, AdaptiveArray, Encoding, encoding_of
from spoolwright.functions.hashing import bytes_hash31, murmur3_32


@pytest.mark.parametrize("n,b", [(0x7F, "7f"), (0x80, "8100"), (0x3FFF, "ff7f"), (0x4000, "818000"), (0x1FFFFF, "ffff7f"), (0x200000, "80c08000")])
def test_uint29(n, b):
    assert codec.uint29_bytes(n).hex() == b
    assert codec.read_uint29(io.BytesIO(bytes.fromhex(b))) == n


@given(st.integers(0, 2**29 - 1))
def test_uint29_round_trip(n):
    assert codec.read_uint29(io.BytesIO(codec.uint29_bytes(n))) == n


@pytest.mark.parametrize(
    "n,b",
    [(0, "00"), (0x7F, "7f"), (0x80, "8080"), (0x3FFF, "bfff"), (0x4000, "c04000"), (0x1FFFFF, "dfffff"), (0x200000, "e0200000"), (0x0E123456, "ee123456"), (0x10000000, "ff10000000"), (-1, "ffffffffff")],
)
def test_prefix_int(n, b):
    assert codec.prefix_int(n).hex() == b and codec.read_prefix_int(io.BytesIO(bytes.fromhex(b))) == n


@given(st.integers(-(2**31), 2**31 - 1), st.text())
def test_prefix_round_trip(n, s):
    assert codec.read_prefix_int(io.BytesIO(codec.prefix_int(n))) == n
    assert codec.read_prefix_string(io.BytesIO(codec.prefix_string(s))) == s


@pytest.mark.parametrize("s,n", [("", 1), ("0", 2), ("abc", 4), ("буквы", 11), ("йй bb", 8)])
def test_prefix_string_sizes(s, n):
    assert len(codec.prefix_string(s)) == n


def test_saved_bytes():
    b = codec.saved_file([("user", 2, None, "a", 10, b"hi")])
    assert b.hex() == "00000002" + "0475736572" + "020161" + "000000000000000a" + "026869"
    assert codec.id_bytes(1, 5, None).hex() == "0100000005" and codec.id_bytes(0, None, None) == b"\0"
    assert list(codec.read_saved(b)) == [("user", 2, None, "a", 10, b"hi")]
    assert list(codec.read_saved(gzip.compress(b), "x.saved.gz")) == list(codec.read_saved(b))


@pytest.mark.parametrize(
    "b",
    [b"", struct.pack(">i", 1), codec.saved_file([("t", 0, None, None, 1, b"x")])[:-1], codec.saved_file([("", 0, None, None, 1, b"x")]), codec.saved_file([("\0", 0, None, None, 1, b"x")]), codec.saved_file([("t", 0, None, None, 1, b"")]), struct.pack(">i", 2) + b"\x01t\x07"],
)
def test_bad_saved(b):
    with pytest.raises(codec.FormatError, match="x.saved"):
        list(codec.read_saved(b, "x.saved"))


def test_bad_utf8_is_replaced():
    b = codec.saved_file([("t", 0, None, None, 1, b"a\xff")])
    assert list(codec.read_saved(b))[0][5] == "a�".encode()


THREE = [("table", 1, 3, None, 123, b"abcdef"), ("qweqwe", 1, 0, None, 523, b"ppp"), ("ros_bill.bill", 1, 90, None, 80, b"some bytes")]


def test_segment_layout():
    b = codec.segment_file(THREE)
    assert [len(codec.segment_record(*r)) for r in THREE] == [26, 24, 38] and len(b) == 152
    assert codec.segment_head(b) == {"version": 2, "total_bytes": 152, "min_ts": 80, "max_ts": 523, "records": 3}
    assert list(codec.read_segment(b)) == list(zip([64, 90, 114], THREE))
    assert [at for at, _ in codec.read_segment(b[:-10])] == [64, 90]  # a cut record is dropped
    assert codec.segment_head(codec.segment_file([]))["min_ts"] == 2**63 - 1


def test_hashes():
    assert murmur3_32([b"", b"test", b"Hello, world!", b"The quick brown fox jumps over the lazy dog"]).view("uint32").tolist() == [0, 0xBA6BD213, 0xC0363E43, 0x2E4FF723]
    rows = {b"some data": -1979199052, b"another data": -906729573, b"second user": 869112007, b"some account": 918089664, b"another 5 account": -633320510, b"abcdef": 1635893381, b"ppp": 1451802801, b"some bytes": -1007670415}
    assert murmur3_32(list(rows)).tolist() == list(rows.values())
    assert bytes_hash31([b"user-1", b"user-2", b"65ebd48c-aca3-45de-9614-40f4095e5531", b""]).tolist() == [-836031825, -836031824, -62872538, 0]
    assert murmur3_32([]).tolist() == [] and bytes_hash31(["йцу".encode()]).tolist() == [sum((b - 256) * 31 ** (5 - i) for i, b in enumerate("йцу".encode())) % 2**32 - 2**32 if sum((b - 256) * 31 ** (5 - i) for i, b in enumerate("йцу".encode())) % 2**32 >= 2**31 else sum((b - 256) * 31 ** (5 - i) for i, b in enumerate("йцу".encode())) % 2**32]


SPLITS = [
    ("abcde", "ee", ["abcde"]), ("abcde", "cd", ["ab", "cde"]), ("abcde", "abcde", ["", "abcde"]), ("abcde", "ab", ["", "abcde"]), ("abcde", "de", ["abc", "de"]),
    ("test", "t", ["", "tes", "t"]), ("test string", "t", ["", "tes", "t s", "tring"]), ("a test string", "t", ["a ", "tes", "t s", "tring"]), ("a---b", "--", ["a", "---b"]), ("a----b", "--", ["a", "--", "--b"]),
]


@pytest.mark.parametrize("s,d,want", SPLITS)
@pytest.mark.parametrize("size", [1, 2, 3, 5, 4096])
def test_split_stream(s, d, want, size):
    assert [p.decode() for p in codec.split_stream(io.BytesIO(s.encode()), d.encode(), size)] == want


def test_encodings():
    a = AdaptiveArray([0, 1, -100, 50000])
    assert a.encoding == Encoding.INT_LONG and a.add(2147483648) == Encoding.LONG
    s = AdaptiveArray(["", "0", "-100", "50000"])
    assert s.encoding == Encoding.INT_STRING and s.add("-2147483648") == Encoding.LONG_STRING and s.add("-9223372036854775808") == Encoding.STRING
    assert all(encoding_of(x) == Encoding.STRING for x in (" ", " 1", "1 ", "025", "-07", "5.0", "+83", "-0", "٣", "-"))
    assert [encoding_of(x) for x in (0, "", 2**31 - 1, -(2**31), 2**31)] == [Encoding.EMPTY_LONG, Encoding.EMPTY_STRING, Encoding.INT_LONG, Encoding.INT_LONG, Encoding.LONG]
    full = AdaptiveArray([5] * MAX_SIZE)
    with pytest.raises(OverflowError):
        full.add(1)
    with pytest.raises(IndexError):
        a[5]
    assert a[4] == 2147483648 and len(a) == 5


@given(st.one_of(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=20), st.lists(st.one_of(st.text(max_size=5), st.integers(-(2**64), 2**64).map(str)), min_size=1, max_size=20)))
def test_array_round_trip(values):
    a = AdaptiveArray(values)
    b = AdaptiveArray.from_bytes(a.to_bytes())
    assert b.values == values and b.encoding == a.encoding
