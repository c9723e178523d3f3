"""Column expressions: text normalisation, guarded dates and ratios, bins. All stay in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and the letters without.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüçñý"
PLAIN = "aaaaaaeeeeiiiiooooouuuucny"
#: Contents of an identifier cell that mean "none", and what separates several identifiers.
NO_ID = ["", "0000000000", "N.D.", "ND", "N/D", "NA", "NULL", "NONE", "-", "--", "---", "N.A.", "//", "/"]
ID_SEPARATORS = [",", ";", "\n", "\r\n", " - ", " / "]


# --- text ---


def tidy(c: Column) -> Column:
    """Trimmed, upper case, runs of white space as one space; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c)), r"\s+", F.lit(" ")), F.lit(""))


def tidy_outcome(c: Column) -> Column:
    """Lower case without accents, apostrophes and hyphens; runs of white space as one space."""
    plain = F.translate(F.lower(F.trim(c)), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"['’`\-]", " "), r"\s+", F.lit(" ")))


def split_ids(c: Column) -> Column:
    """Array of the non-blank parts of a cell, split at the first kind of separator it contains."""
    parts = F.array(c)
    for s in reversed(ID_SEPARATORS):
        parts = F.when(F.contains(c, F.lit(s)), F.split(c, "\\Q" + s + "\\E")).otherwise(parts)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def valid_id(c: Column, length: int = 10) -> Column:
    """The upper-case identifier if it has the right length, letters and digits only, and stands for no "none"."""
    up = F.upper(F.trim(c))
    return F.when(~up.isin(NO_ID) & (F.char_length(up) == length) & up.rlike(r"^[\p{L}\p{N}]+$"), up)


def year_in(c: Column) -> Column:
    """The first year from 2000 on that stands alone in a text."""
    return F.nullif(F.regexp_extract(c, r"\b(20\d\d)\b", 1), F.lit("")).cast("int")


def uid(*parts: Column) -> Column:
    """Parts joined by a bar; a null part is an empty one."""
    out = F.coalesce(parts[0].cast("string"), F.lit(""))
    for p in parts[1:]:
        out = F.concat(out, F.lit("|"), F.coalesce(p.cast("string"), F.lit("")))
    return out


def plain_code(c: Column) -> Column:
    """A code without `.0` at its end and zeros at its start; null if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"\.0$", ""), r"^0+", "")
    return F.when(~F.lower(s).isin("", "nan", "none"), s)


def number(c: Column) -> Column:
    """Double from text with a decimal comma or point, blanks ignored; null on anything else."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"\s", ""), ",", ".").try_cast("double")


def thousands(c: Column) -> Column:
    """Double from text with points for thousands and a decimal comma."""
    return F.regexp_replace(F.regexp_replace(F.trim(c.cast("string")), r"\.", ""), ",", ".").try_cast("double")


def first_match(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: Column | None = None) -> Column:
    """The name of the first rule of which some word is in the text; a null text is null."""
    out = default if default is not None else c
    for name, needles in reversed(rules):
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(c, F.lit(n))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def look_up(c: Column, table: Mapping, default=None) -> Column:
    """Value of a literal mapping; default, or null, for what it lacks."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)
    return found if default is None else F.when(c.isNotNull(), F.coalesce(found, F.lit(default)))


def prefix_class(c: Column, table: Mapping[str, str], default: str, width: int = 2) -> Column:
    """Class of a code's first characters; default for others; null for null and blank codes."""
    return F.when(F.trim(c) != "", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.substring(F.trim(c), 1, width)), F.lit(default)))


# --- dates ---


def moment(c: Column, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"), low: str = "1990-01-01", high: str = "2030-12-31") -> Column:
    """Timestamp by the first format that fits; null for garbage and for what lies outside of the range.

    A text that is shorter than a format or lacks one of its signs can't fit it; each such try would cost an exception.
    """
    v = F.trim(c)

    def fits(f: str) -> Column:
        if {x for x in f if x.isalpha()} - set("yMdHms") or "MMM" in f or {*f} & {*"'[]{}#"}:
            return F.lit(True)  # names of months, optional and quoted parts can be of any length
        signs = [F.contains(v, F.lit(x)) for x in sorted({x for x in f if not x.isalpha()})]
        return reduce(lambda a, b: a & b, signs, F.char_length(v) >= len(f))

    t = F.coalesce(*[F.when(fits(f), F.try_to_timestamp(v, F.lit(f))) for f in formats])
    return F.when(t.between(F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")), t)


def days_between(a: Column, b: Column) -> Column:
    """Whole days from a to b, rounded down; negative if b is earlier."""
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("long")


def lag_days(a: Column, b: Column) -> Column:
    """days_between where it isn't negative, else null."""
    d = days_between(a, b)
    return F.when(d >= 0, d)


# --- numbers ---


def ratio(a: Column, b: Column, low: float | None = None, high: float | None = None) -> Column:
    """a over b; null for a zero or null divisor and, if given, outside of [low, high]."""
    r = F.try_divide(a, b)
    return r if low is None else F.when(r.between(low, high), r)


def clamp(c: Column, low, high) -> Column:
    """c within [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def row_sum(*columns: Column) -> Column:
    """Sum of the values that aren't null; 0 if all are."""
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(c, F.lit(0.0))
    return out


def excluded_share(admitted: Column, excluded: Column, firms: Column) -> Column:
    """Excluded bids over the larger of all firms and all bids."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.greatest(zero(firms), zero(admitted) + zero(excluded))
    return F.when(total > 0, excluded / total)


def near(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    """Whether both are known and differ by less than the tolerance; never null."""
    return F.coalesce(F.abs(a - b) < tolerance, F.lit(False))


def first_digit(c: Column) -> Column:
    """First digit of a positive number's integer part; null otherwise."""
    return F.when(c >= 1, F.substring(F.floor(c).cast("string"), 1, 1).cast("int"))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    p = hits / n
    middle, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)


# --- bins and missing values ---


def fixed_bins(c: Column, edges: Sequence[float], labels: Sequence[str], right: bool = True, missing: str = "MISSING") -> Column:
    """Label of the bin that holds c: up to and with each edge (right) or below it; missing for null."""
    out = F.lit(labels[-1])
    for e, name in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(c <= e if right else c < e, F.lit(name)).otherwise(out)
    return F.when(c.isNull(), F.lit(missing)).otherwise(out)


def exact_bins(c: Column, singles: Mapping[float, str], edges: Sequence[float], labels: Sequence[str], missing: str = "MISSING") -> Column:
    """Labels for single values, and bins for the rest."""
    out = fixed_bins(c, edges, labels, True, missing)
    for value, name in singles.items():
        out = F.when(c == value, F.lit(name)).otherwise(out)
    return out


def quantile_bins(c: Column, breaks: Sequence[float | Column], missing: str = "MISSING") -> Column:
    """Q1, Q2, ... by right-closed breaks, the lowest included; equal breaks leave their bin empty."""
    out = F.lit(f"Q{len(breaks) - 1}")
    for i in range(len(breaks) - 2, 0, -1):
        b = breaks[i] if isinstance(breaks[i], Column) else F.lit(breaks[i])
        out = F.when(c <= b, F.lit(f"Q{i}")).otherwise(out)
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (breaks[0], breaks[-1]))
    return F.when(c.isNull() | (c < low) | (c > high), F.lit(missing)).otherwise(out)


def flag_text(c: Column, missing: str = "MISSING") -> Column:
    """'1', '0' or missing."""
    return F.when(c.isNull(), F.lit(missing)).when(c.cast("double") != 0, F.lit("1")).otherwise(F.lit("0"))
