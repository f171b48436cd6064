"""Columns decoded from bytes and bit fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 12 sync bytes that open a full-size record, in hex.
SYNC_HEX = "00FFFFFFFFFFFFFFFFFFFF00"
# Records per second and per minute of the position code, and its lead-in.
PER_SECOND, PER_MINUTE, LEAD_IN = 75, 75 * 60, 150
# Fixed values: (shift, width) of each flag in the sub-mode byte.
SUBMODE_BITS = {"end_of_record": (0, 1), "video": (1, 1), "audio": (2, 1), "data": (3, 1),
                "trigger": (4, 1), "form": (5, 1), "real_time": (6, 1), "end_of_file": (7, 1)}
# Fixed values: (shift, width) of each field in the coding byte, and the bits that must be zero.
CODING_BITS = {"stereo": (0, 1), "half_rate": (2, 1), "eight_bit": (4, 1), "emphasis": (6, 1)}
CODING_RESERVED = 0x2A


def byte_hex(hex_text: Column, index: int) -> Column:
    """The two hex digits of byte ``index``."""
    return F.substring(hex_text, 2 * index + 1, 2)


def byte_int(hex_text: Column, index: int) -> Column:
    return F.conv(byte_hex(hex_text, index), 16, 10).cast("int")


def bcd(hex_text: Column, index: int) -> Column:
    """Byte ``index`` as two decimal digits; null if a digit is above 9."""
    digits = byte_hex(hex_text, index)
    return F.when(digits.rlike("^[0-9]{2}$"), digits).cast("int")


def mismatches(hex_text: Column, expected_hex: str) -> Column:
    """Number of leading bytes that differ from ``expected_hex``; missing bytes differ."""
    out = F.lit(0)
    for i in range(len(expected_hex) // 2):
        same = byte_hex(hex_text, i) == F.lit(expected_hex[2 * i:2 * i + 2])
        out = out + F.when(same, 0).otherwise(1)
    return out


def bit_field(value: Column, shift: int, width: int = 1) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit((1 << width) - 1))
