"""Column expressions shared by the operators.

Everything here stays on the JVM: no Python is run per row.  A function takes
column names or Columns and returns a Column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Part of the public result contract.
DIRECTION_POSITIVE = "positive_higher_target_severity"
DIRECTION_NEGATIVE = "negative_lower_target_severity"
DIRECTION_ZERO = "zero"
DIRECTION_NONE = "not_estimable"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- names and identifiers

def normalize_symbol(c) -> Column:
    """Trimmed, upper-case feature name."""
    return F.upper(F.trim(col(c)))


def symbol_in_parentheses(c) -> Column:
    """Text of a final ``(SYMBOL)``, trimmed and upper-case; no such text -> empty string."""
    return F.upper(F.trim(F.regexp_extract(col(c), r"\(([^()]+)\)\s*$", 1)))


def feature_id_prefix(c) -> Column:
    """Leading stable identifier, empty when there is none."""
    return F.regexp_extract(col(c), r"^(ENSG[0-9]+)", 1)


def without_version(c) -> Column:
    """Identifier up to the first dot."""
    return F.substring_index(col(c), ".", 1)


def has_prefix(c, prefix: str = "MT-") -> Column:
    return normalize_symbol(c).startswith(prefix)


def barcode_prefix(c, separator: str = "_") -> Column:
    """Sample key in front of the first separator."""
    return F.substring_index(col(c), separator, 1)


def donor_key(*candidates) -> Column:
    """First candidate that is neither NULL nor blank."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in candidates])


# ---------------------------------------------------------------- coercion and formatting

def finite(c) -> Column:
    """NaN and infinities become NULL, so they are never grouped or ordered as values.

    Spark orders NaN above infinity, so one comparison covers all three.
    """
    c = col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_number(c) -> Column:
    """Text to double; unparsable, NaN and infinite values become NULL."""
    return finite(F.trim(col(c)).try_cast("double"))


def parse_bool_strict(c) -> Column:
    """true/false in any case; everything else is NULL (a violation for the caller's gate)."""
    text = F.lower(F.trim(col(c)))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def format_fixed(c, digits: int = 8) -> Column:
    """Fixed decimals, blank when missing or not finite."""
    c = finite(col(c).cast("double"))
    return F.when(c.isNull(), F.lit("")).otherwise(F.format_string(f"%.{digits}f", c))


def split_list(c, separator: str = ";") -> Column:
    """Delimited text to an array of trimmed non-empty items."""
    return F.filter(F.transform(F.split(col(c), separator), lambda x: F.trim(x)),
                    lambda x: F.length(x) > 0)


def is_blank(c) -> Column:
    c = col(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


# ---------------------------------------------------------------- reasons and labels

def reason_list(*rules: tuple[Column, str], none: str = "pass") -> Column:
    """Ordered ``;`` join of the reasons whose condition holds, ``none`` when no one does."""
    joined = F.concat_ws(";", *[F.when(cond, F.lit(text)) for cond, text in rules])
    return F.when(joined == "", F.lit(none)).otherwise(joined)


def first_reason(*rules: tuple[Column, str], none: str) -> Column:
    """The first reason whose condition holds."""
    out = F
    for cond, text in rules:
        out = out.when(cond, F.lit(text))
    return out.otherwise(F.lit(none))


def arm_label(group, comparison, target) -> Column:
    """Contrast arm of a two-valued group column; NULL outside the contrast."""
    group, comparison, target = col(group), col(comparison), col(target)
    return F.when(group == comparison, F.lit("comparison")).when(group == target, F.lit("target"))


def effect_direction(effect) -> Column:
    """The exact sign of an effect; NULL and non-finite ones have none."""
    e = finite(effect)
    return (F.when(e.isNull(), F.lit(DIRECTION_NONE))
            .when(e > 0, F.lit(DIRECTION_POSITIVE))
            .when(e < 0, F.lit(DIRECTION_NEGATIVE))
            .otherwise(F.lit(DIRECTION_ZERO)))


def is_directional(direction) -> Column:
    return col(direction).isin(DIRECTION_POSITIVE, DIRECTION_NEGATIVE)


def selection(c, pattern: str, inside: str, outside: str) -> Column:
    """Named in/out arm of a full-match regex."""
    return F.when(col(c).rlike(f"^(?:{pattern})$"), F.lit(inside)).otherwise(F.lit(outside))


def versus_label(n_target, n_comparison) -> Column:
    return F.format_string("%d vs %d", col(n_target), col(n_comparison))


def interval_label(low, high, digits: int = 3) -> Column:
    low, high = col(low), col(high)
    return F.when(low.isNull() | high.isNull(), F.lit("")).otherwise(
        F.format_string(f"[%.{digits}f, %.{digits}f]", low, high))


# ---------------------------------------------------------------- scales

def log1p_cpm(count, total) -> Column:
    """log1p of counts per million; NULL when the total is not positive."""
    total = col(total)
    return F.when(total > 0, F.log1p(F.lit(1e6) * col(count) / total))


def log1p_cpm_floor(count, total) -> Column:
    """Cell-panel variant: a total below one counts as one."""
    return F.log1p(F.lit(1e6) * col(count) / F.greatest(col(total), F.lit(1)))


def log1p_value(value) -> Column:
    """Processed scales carry no library total."""
    return F.log1p(col(value))


# ---------------------------------------------------------------- hashing

def set_fingerprint(members) -> Column:
    """SHA-256 over the newline-joined sorted distinct members of an array column."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(col(members))), "\n"), 256)


def stable_seed(seed: int, *parts, template: tuple[str, ...] = ()) -> Column:
    """Unsigned 64-bit seed as decimal text: the first 8 bytes of SHA-256, little-endian.

    The value does not fit a signed long, so it stays text.
    """
    payload = F.concat_ws("|", F.lit(str(seed)), *[F.lit(t) for t in template],
                          *[col(p) for p in parts])
    digest = F.sha2(payload, 256)
    swapped = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(swapped, 16, 10)


def hash_draw(bound, *parts) -> Column:
    """Uniform integer in [0, bound) keyed by the parts; the same on every engine and layout."""
    digest = F.md5(F.concat_ws("|", *[col(p).cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % col(bound)


# ---------------------------------------------------------------- text

def characteristic_key(c) -> Column:
    """Key of ``key: value`` text, lower-cased with collapsed blanks; NULL without a colon."""
    c = col(c)
    key = F.regexp_replace(F.lower(F.trim(F.substring_index(c, ":", 1))), r"\s+", " ")
    return F.when(c.contains(":"), key)


def characteristic_value(c) -> Column:
    c = col(c)
    return F.when(c.contains(":"), F.trim(F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1)))


def title_grade(c) -> Column:
    return F.regexp_extract(col(c), r"(?i)Thompson\s+grade\s+([A-Za-z0-9-]+)", 1)


# Two published title layouts: "NP-60F, ..." (age then sex) and "NP-F60, ..." (sex then age).
_AGE_SEX = r"(?:^|[^0-9])([0-9]{1,3})([FM])(?:\s*,|\s*$)"
_SEX_AGE = r"-([FM])([0-9]{1,3})(?:\s*,|\s*$)"


def title_age(c) -> Column:
    c = col(c)
    return F.when(c.rlike(_AGE_SEX), F.regexp_extract(c, _AGE_SEX, 1)).otherwise(
        F.regexp_extract(c, _SEX_AGE, 2))


def title_sex(c) -> Column:
    c = col(c)
    return F.when(c.rlike(_AGE_SEX), F.regexp_extract(c, _AGE_SEX, 2)).otherwise(
        F.regexp_extract(c, _SEX_AGE, 1))


def title_prefix(c) -> Column:
    return F.trim(F.substring_index(col(c), ",", 1))


def title_severity(c) -> Column:
    word = F.lower(F.regexp_extract(col(c), r"(?i)\b(mildly|severely)\b", 1))
    return F.when(word == "mildly", F.lit("mild")).when(word == "severely", F.lit("severe"))


def title_replicate(c) -> Column:
    return F.regexp_extract(col(c), r"(?i)replicate\s*([0-9]+)", 1)


def severity_from_status(c) -> Column:
    status = F.upper(F.trim(col(c)))
    return (F.when(status == "MDD", F.lit("mild")).when(status == "SDD", F.lit("severe"))
            .otherwise(F.lit("unresolved")))


def library_label(c) -> Column:
    """Library label of an archive member name such as ``GSM1_NP12.tar.gz``."""
    return F.regexp_extract(col(c), r"(NP[0-9]+)", 1)


def reverse_complement(c) -> Column:
    return F.reverse(F.translate(col(c), "ACGTN", "TGCAN"))


def usable_sequence(sequence, is_control, minimum_length: int = 45,
                    alphabet: str = "ACGTN") -> Column:
    s = col(sequence)
    return (~col(is_control)) & (F.length(s) >= minimum_length) & s.rlike(f"^[{alphabet}]+$")


def normalize_newlines(c) -> Column:
    return F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def sanitize_text(c, literals: dict[str, str]) -> Column:
    """LF line ends, then each literal replaced in the order given."""
    out = normalize_newlines(c)
    for source, replacement in literals.items():
        out = F.replace(out, F.lit(source), F.lit(replacement))
    return out


# ---------------------------------------------------------------- gamma function

# Lanczos coefficients (g = 7, 9 terms), public numerical constants.
_LANCZOS_G = 7.0
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028,
            771.32342877765313, -176.61502916214059, 12.507343278686905,
            -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x) -> Column:
    """ln Γ(x) for x ≥ 0.5, as a native expression (Spark has none)."""
    x = col(x) - F.lit(1.0)
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + F.lit(_LANCZOS_G + 0.5)
    return (F.lit(0.9189385332046727) + (x + F.lit(0.5)) * F.log(t) - t + F.log(series))


def small_sample_factor(m) -> Column:
    """J(m) = Γ(m/2) / (√(m/2) Γ((m-1)/2)); NULL for m ≤ 1.

    The Lanczos sum needs arguments of at least one half, so the lower gamma is taken one
    step up: Γ(a) = Γ(a+1)/a.
    """
    m = col(m).cast("double")
    a = (m - F.lit(1.0)) / F.lit(2.0)
    half = m / F.lit(2.0)
    log_j = log_gamma(half) - (log_gamma(a + F.lit(1.0)) - F.log(a)) - F.lit(0.5) * F.log(half)
    return F.when(m > 1, F.exp(log_j))
