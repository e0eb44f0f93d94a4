"""Vehicle numbers, fault codes and name-based ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check-digit weights by position and digit values of letters of a vehicle number; fault code systems.
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_LETTERS, VIN_DIGITS = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
VIN_YEARS = "ABCDEFGHJKLMNPRSTVWXY123456789"
DTC_SYSTEMS = "PCBU"
DTC_PATTERN = "^[PCBU][0-3][0-9A-F]{3}$"
VIN_PATTERN = "^[A-HJ-NPR-Z0-9]{17}$"


def vin_format_ok(vin: Column) -> Column:
    return F.coalesce(vin.rlike(VIN_PATTERN), F.lit(False))


def vin_check_digit(vin: Column) -> Column:
    """The check digit that the other 16 places call for; null for vehicle numbers that are malformed."""
    digits = F.split(F.translate(vin, VIN_LETTERS, VIN_DIGITS), "")
    weights = F.array(*map(F.lit, VIN_WEIGHTS))
    rest = F.aggregate(F.zip_with(digits, weights, lambda d, w: F.coalesce(d.try_cast("int"), F.lit(0)) * w), F.lit(0), lambda a, x: a + x) % 11
    return F.when(vin_format_ok(vin), F.when(rest == 10, "X").otherwise(rest.cast("string")))


def vin_valid(vin: Column) -> Column:
    return F.coalesce(vin_check_digit(vin) == F.substring(vin, 9, 1), F.lit(False))


def vin_maker(vin: Column) -> Column:
    return F.substring(vin, 1, 3)


def vin_year_code(year: Column) -> Column:
    """The letter or digit of a model year, which comes round every thirty years."""
    return F.substring(F.lit(VIN_YEARS), F.pmod(year - 1980, F.lit(30)).cast("int") + 1, F.lit(1))


def vin_build(maker: Column, model: Column, year: Column, plant: Column, serial: Column) -> Column:
    """A vehicle number of its parts with its check digit; null for parts of a wrong length or serials over six digits."""
    open_ = F.concat(maker, model, F.lit("0"), vin_year_code(year), plant, F.lpad(serial.cast("string"), 6, "0"))
    fine = (F.length(maker) == 3) & (F.length(model) == 5) & serial.between(0, 999_999)
    return F.when(fine, F.concat(F.substring(open_, 1, 8), vin_check_digit(open_), F.substring(open_, 10, 8)))


def dtc_valid(codes: Column) -> Column:
    """Whether every code of an array is well formed; an empty or null array is."""
    return F.coalesce(F.forall(codes, lambda c: F.coalesce(c.rlike(DTC_PATTERN), F.lit(False))), F.lit(True))


def dtc_of_word(word: Column) -> Column:
    """A fault code from its two-byte number: system, digit, three hex places."""
    system = F.substring(F.lit(DTC_SYSTEMS), F.shiftright(word, 14).bitwiseAND(3) + 1, F.lit(1))
    return F.concat(system, F.shiftright(word, 12).bitwiseAND(3).cast("string"), F.lpad(F.conv(word.bitwiseAND(0xFFF).cast("string"), 10, 16), 3, "0"))


def dtc_word(code: Column) -> Column:
    """The two-byte number of a fault code; null for malformed ones."""
    system = F.when(code.startswith("P"), 0).when(code.startswith("C"), 1).when(code.startswith("B"), 2).otherwise(3)
    rest = F.conv(F.substring(code, 3, 3), 16, 10).try_cast("int")
    return F.when(code.rlike(DTC_PATTERN), system * 16384 + F.substring(code, 2, 1).try_cast("int") * 4096 + rest)


def dtcs_of_hex(words: Column) -> Column:
    """Fault codes of a string of 4-digit hex words."""
    n = F.floor(F.length(words) / 4).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: dtc_of_word(F.conv(F.substring(words, i * 4 + 1, F.lit(4)), 16, 10).try_cast("int")))


def dtc_system(code: Column) -> Column:
    first = F.substring(F.upper(F.trim(code)), 1, 1)
    return F.when(first == "P", "powertrain").when(first == "C", "chassis").when(first == "B", "body").when(first == "U", "network")


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The name-based id (SHA-1, version 5) of `name` in a namespace given as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    place = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(place.bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
