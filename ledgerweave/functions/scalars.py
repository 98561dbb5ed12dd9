"""Column functions: null tokens, tolerant casts, UTC text, rounding, byte fields, base-58."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Texts that stand for NULL in ledger files.
NULL_TOKENS = ["", "<nil>", "NULL", "null"]

# Fixed value: the base-58 alphabet of addresses and instruction data.
BASE58_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

MICROS_PER_DAY = 86_400_000_000


def null_token(col: Column) -> Column:
    return F.when(~col.isin(NULL_TOKENS), col)


def tolerant_double(col: Column, default: float | None = 0.0) -> Column:
    """Text to double; a null token gives ``default``, unreadable text gives NULL."""
    text = null_token(col)
    value = text.try_cast("double")
    return value if default is None else F.when(text.isNull(), F.lit(default)).otherwise(value)


def tolerant_long(col: Column, default: int | None = 0) -> Column:
    """Text to integer by way of double, truncating toward zero."""
    text = null_token(col)
    number = text.try_cast("double")
    value = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint")
    return value if default is None else F.when(text.isNull(), F.lit(default)).otherwise(value)


def long_or_zero(col: Column) -> Column:
    """As :func:`tolerant_long`, but unreadable text is zero as well."""
    return F.coalesce(tolerant_long(col, None), F.lit(0).cast("bigint"))


def parse_utc(col: Column) -> Column:
    """Read ``... UTC``, ``...Z``, ``+00:00``, naive or date-only text, or epoch seconds."""
    text = F.trim(null_token(col))
    bare = F.regexp_replace(F.regexp_replace(text, r"( UTC|Z)$", "+00:00"), "T", " ")
    seconds = text.try_cast("double")
    return F.when(seconds.isNotNull(), F.timestamp_micros((seconds * 1_000_000).cast("bigint"))).otherwise(
        bare.try_cast("timestamp")
    )


def iso_z(ts: Column) -> Column:
    """UTC text with seconds; sub-second digits appear only when present."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")), F.lit("Z"))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_text(ts: Column) -> Column:
    """First day of the month as text."""
    return F.date_format(ts, "yyyy-MM-01")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed days as a double."""
    return (epoch_micros(later) - epoch_micros(earlier)).cast("double") / F.lit(float(MICROS_PER_DAY))


def duration_text(later: Column, earlier: Column) -> Column:
    """Elapsed time as whole days below 60, months below 730 days, then years, with one decimal at most.

    Tenths are counted in whole numbers: a month is 487 / 16 days and a year 1461 / 4.
    """
    days = F.greatest(F.lit(0), F.floor(days_between(later, earlier))).cast("bigint")
    month, year = F.floor((days * 320 + 487) / 974), F.floor((days * 80 + 1461) / 2922)
    tenths = F.when(days < 730, month).otherwise(year).cast("bigint")
    decimal = F.when(tenths % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("."), (tenths % 10).cast("string")))
    number = F.concat(F.floor(tenths / 10).cast("string"), decimal)
    text = F.when(days < 60, F.concat(days.cast("string"), F.lit("d"))).when(days < 730, F.concat(number, F.lit("mo")))
    return F.when(later.isNull() | earlier.isNull(), F.lit("—")).otherwise(text.otherwise(F.concat(number, F.lit("y"))))


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    ``round`` and ``bround`` round the shortest decimal text of a double, so 2.675 becomes
    2.68 although the stored number lies below the tie. The fraction is scaled by 2**62, which
    is exact, and compared with the half in decimal arithmetic.
    """
    scale = 10**digits
    one = 2**62
    whole = F.floor(value)
    fraction = ((value - whole) * F.lit(float(one))).cast("bigint").cast(DecimalType(20, 0))
    scaled = (fraction * F.lit(scale)).cast(DecimalType(38, 0))
    one_d = F.lit(str(one)).cast(DecimalType(20, 0))
    half = F.lit(str(one // 2)).cast(DecimalType(20, 0))
    rest = (scaled % one_d).cast(DecimalType(38, 0))
    steps = ((scaled - rest) / one_d).cast("bigint")
    up = (rest > half) | ((rest == half) & (steps % 2 == 1))
    total = whole.cast("bigint") * scale + steps + F.when(up, 1).otherwise(0)
    return total.cast("double") / F.lit(float(scale))


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    """``100 * part / whole`` with zero for an empty whole."""
    share = F.when(whole == 0, F.lit(0.0)).otherwise(
        F.lit(100.0) * part.cast("double") / F.when(whole != 0, whole).cast("double")
    )
    return share if digits is None else round_half_even(share, digits)


def trimmed_number(amount: Column) -> Column:
    """Decimal with nine places as text without trailing zeros."""
    text = amount.cast(DecimalType(38, 9)).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def exact_sum(col: Column) -> Column:
    """Sum of integer base units that cannot overflow however many rows there are."""
    return F.sum(col.cast(DecimalType(20, 0)))


def units(total: Column, places: int) -> Column:
    """Base units to a double in the last projection."""
    return F.coalesce(total, F.lit(0)).cast("double") / F.lit(float(10**places))


def uint_le(data: Column, start: int, width: int) -> Column:
    """Unsigned little-endian integer of ``width`` bytes at a 1-based offset; NULL when too short."""
    digits = F.hex(F.substring(data, start, width))
    pairs = [F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]
    number = F.conv(F.concat(*pairs), 16, 10).cast(DecimalType(20, 0))
    return F.when(F.length(data) >= start + width - 1, number)


def starts_with_hex(data: Column, prefix_hex: str) -> Column:
    """Does binary ``data`` begin with these bytes?"""
    size = len(prefix_hex) // 2
    return F.substring(data, 1, size) == F.unhex(F.lit(prefix_hex))


def base58_ok(text: Column) -> Column:
    return text.rlike(f"^[{BASE58_ALPHABET}]*$")


def base58_to_binary(text: Column) -> Column:
    """Base-58 text to bytes with built-in array functions; NULL on a foreign character.

    Five characters are folded at a time into a list of 32-bit limbs, least significant first.
    """
    step = 5
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / step), F.lit(0))),
        lambda i: F.substring(text, (i * step + 1).cast("int"), F.lit(step)),
    )

    powers = F.array(*[F.lit(58**i).cast("bigint") for i in range(step + 1)])

    def digit(piece: Column, i: int) -> Column:
        return (F.instr(F.lit(BASE58_ALPHABET), F.substring(piece, i, 1)) - 1).cast("bigint")

    def piece_value(piece: Column) -> Column:
        terms = [
            F.when(F.length(piece) >= i, digit(piece, i) * F.get(powers, F.length(piece) - i)).otherwise(0)
            for i in range(1, step + 1)
        ]
        return sum(terms[1:], terms[0])

    def weight(piece: Column) -> Column:
        return F.get(powers, F.length(piece))

    mask = F.lit(0xFFFFFFFF).cast("bigint")
    no_limbs = F.array().cast("array<bigint>")

    def times_add(limbs: Column, piece: Column) -> Column:
        start = F.struct(no_limbs.alias("out"), piece_value(piece).alias("carry"))

        def limb_step(acc: Column, limb: Column) -> Column:
            total = limb * weight(piece) + acc["carry"]
            return F.struct(
                F.concat(acc["out"], F.array(total.bitwiseAND(mask))).alias("out"),
                F.shiftright(total, 32).alias("carry"),
            )

        return F.aggregate(
            limbs,
            start,
            limb_step,
            lambda acc: F.when(acc["carry"] > 0, F.concat(acc["out"], F.array(acc["carry"]))).otherwise(acc["out"]),
        )

    limbs = F.aggregate(groups, no_limbs, times_add)
    digits = F.array_join(F.transform(F.reverse(limbs), lambda v: F.lpad(F.hex(v), 8, "0")), "")
    body = F.regexp_replace(digits, "^(00)+", "")
    zeros = F.repeat(F.lit("00"), F.length(text) - F.length(F.regexp_replace(text, "^1+", "")))
    return F.when(base58_ok(text), F.unhex(F.concat(zeros, body)))


def address_ok(text: Column) -> Column:
    """A wallet address: 32 to 44 base-58 characters that decode to 32 bytes."""
    shaped = F.length(text).between(32, 44) & base58_ok(text)
    return F.when(shaped, F.length(base58_to_binary(text)) == 32).otherwise(F.lit(False))
