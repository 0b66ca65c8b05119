"""Derived fields as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..paths import unsafe_reason_column


def unsafe_path_reason(name: Column) -> Column:
    """Why a member name isn't safe; null for a safe one."""
    return unsafe_reason_column(name)


def safe_path(name: Column) -> Column:
    return unsafe_reason_column(name).isNull()


def cpio_kind(mode: Column) -> Column:
    """A POSIX mode's kind."""
    kinds = {0o040000: "directory", 0o100000: "file", 0o120000: "symlink", 0o010000: "fifo", 0o020000: "character_device", 0o060000: "block_device", 0o140000: "socket"}
    out = F.lit("unknown")
    for bits, name in kinds.items():
        out = F.when(mode.bitwiseAND(0o170000) == bits, name).otherwise(out)
    return F.when(mode.isNotNull(), out)


def unix_mode_7z(attributes: Column) -> Column:
    """The mode in the upper half of 7z attributes, if bit 0x8000 says that there is one."""
    return F.when(attributes.bitwiseAND(0x8000) != 0, F.shiftright(attributes, 16))


def kind_7z(is_anti_item: Column, is_symlink: Column, has_stream: Column, is_empty_file: Column) -> Column:
    return F.when(is_anti_item, "anti_item").when(is_symlink, "symlink").when(has_stream | is_empty_file, "file").otherwise("directory")


def filetime_timestamp(ticks: Column) -> Column:
    """The timestamp of a FILETIME (100 ns since 1601, decimal(20,0)); null where a timestamp can't hold it."""
    micros = F.floor((ticks.cast("decimal(22,0)") - F.lit(116444736000000000).cast("decimal(22,0)")) / 10)
    fits = micros.between(-62135596800000000, 253402300799999999)
    return F.timestamp_micros(F.when(fits, micros.cast("long")))


def dos_timestamp(date: Column, time: Column) -> Column:
    """The timestamp (in the session's zone) of DOS date and time; null where the calendar has no such day or second."""
    year, month, day = F.shiftright(date, 9) + 1980, F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31)
    hour, minute, second = F.shiftright(time, 11), F.shiftright(time, 5).bitwiseAND(63), time.bitwiseAND(31) * 2
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, day, hour, minute, second)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
