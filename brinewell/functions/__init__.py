"""Column functions: hashes, checksums, encodings, key text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seeds of the hash functions of Bloom and Count-Min sketches: this number and those after it, as four bytes.
BASE_SEED = 0x65920080

# Words that carry no meaning for SimHash.
STOP_WORDS = (
    "the", "a", "an", "in", "and", "or", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "this", "that", "these", "those", "there", "here", "where", "what", "when", "while", "which",
    "who", "how", "if", "yes", "no", "not", "be", "been", "being", "is", "was", "were", "am", "are", "have", "has", "do", "does",
)


def seed_bytes(i: int) -> bytes:
    return (BASE_SEED + i).to_bytes(4, "big")


def u64_hex(data: Column) -> Column:
    """The first eight bytes of MD5 as 16 hexadecimal digits: an unsigned number of 64 bits, most significant first."""
    return F.substring(F.md5(data), 1, 16)


def u64_bits(digits: Column) -> Column:
    """The bit pattern of such a number as a long."""
    return F.conv(digits, 16, -10).cast("bigint")


def u64_mod(digits: Column, m: int) -> Column:
    """Such a number modulo m, unsigned."""
    return (F.conv(digits, 16, 10).cast("decimal(20,0)") % F.lit(m)).cast("bigint")


def seeded_slot(item: Column, i: int, m: int) -> Column:
    """Slot of an item under the i-th seeded hash function."""
    return u64_mod(u64_hex(F.concat(F.encode(item, "UTF-8"), F.lit(seed_bytes(i)))), m)


def first_set_bit(digits: Column) -> Column:
    """Trailing zero bits plus one; 65 for zero."""
    at = F.instr(F.reverse(F.conv(digits, 16, 2)), "1")
    return F.when(at == 0, 65).otherwise(at).cast("bigint")


def entry_crc(key: Column, value: Column) -> Column:
    return F.crc32(F.encode(F.concat(key, F.coalesce(value, F.lit(""))), "UTF-8"))


def varint_length(x: Column) -> Column:
    """Bytes of an unsigned number at seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("bigint")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Lower-cased ASCII words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\w+)"), 1)


def tokens(text: Column) -> Column:
    """Lower-cased ASCII words without stop words."""
    return F.filter(words(text), lambda w: ~F.array_contains(F.array(*map(F.lit, STOP_WORDS)), w))


def varint(x: Column) -> Column:
    """An unsigned number at seven bits a byte, lowest first; all bytes but the last have their top bit set."""
    last = varint_length(x) - 1
    digit = lambda i: F.call_function("shiftrightunsigned", x, (i * 7).cast("int")).bitwiseAND(127) + F.when(i < last, 128).otherwise(0)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda i: F.lpad(F.hex(digit(i)), 2, "0")), ""))


def varint_value(data: Column) -> Column:
    """The number that such bytes encode; null for no bytes."""
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    byte = lambda i: F.conv(F.substring(F.hex(data), 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
    value = F.aggregate(places, F.lit(0).cast("bigint"), lambda a, i: a.bitwiseOR(F.call_function("shiftleft", byte(i).bitwiseAND(127), (i * 7).cast("int"))))
    return F.when(F.octet_length(data) > 0, value)
