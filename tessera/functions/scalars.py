"""Tolerant scalar functions: text to typed values, names, units, ratios. Each takes and gives Columns.

Text that doesn't parse gives null, never an error; null gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

# Letters that names are compared without accents by, and what they become.
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñçčćšžđ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncccszd"

# Franchise name of each team code, present and past.
FRANCHISES = {
    "atlanta hawks": ["ATL", "STL", "MLH", "TRI"],
    "brooklyn nets": ["BRK", "BKN", "NJN"],
    "charlotte hornets": ["CHO", "CHH", "CHA"],
    "detroit pistons": ["DET", "FTW"],
    "golden state warriors": ["GSW", "SFW", "PHW"],
    "los angeles clippers": ["LAC", "SDC", "BUF"],
    "los angeles lakers": ["LAL", "MNL"],
    "memphis grizzlies": ["MEM", "VAN"],
    "new orleans pelicans": ["NOP", "NOH", "NOK"],
    "oklahoma city thunder": ["OKC", "SEA"],
    "philadelphia 76ers": ["PHI", "SYR"],
    "phoenix suns": ["PHX", "PHO"],
    "sacramento kings": ["SAC", "KCO", "KCK", "CIN", "ROC"],
    "san antonio spurs": ["SAS", "SAN"],
    "utah jazz": ["UTA", "NOJ"],
    "washington wizards": ["WAS", "WSB", "BAL", "WSH"],
}

# Code of today for each historic code.
CANONICAL = {
    "BRK": ["NJN", "BKN"],
    "CHO": ["CHH", "CHA"],
    "DET": ["FTW"],
    "GSW": ["GOS", "SFW", "PHW"],
    "LAC": ["SDC", "BUF"],
    "LAL": ["MNL"],
    "MEM": ["VAN"],
    "NOP": ["NOH", "NOK"],
    "OKC": ["SEA"],
    "PHI": ["SYR"],
    "PHX": ["PHO"],
    "SAC": ["KCO", "KCK", "CIN", "ROC"],
    "SAS": ["SAN"],
    "WAS": ["WSB", "BAL", "WSH"],
}

KG_PER_LB = 0.45359237
CM_PER_INCH = 2.54


def to_int(text: Column) -> Column:
    """Integer, or null. `12.0` is not one."""
    return F.trim(text.cast("string")).try_cast("int")


def to_int_loose(text: Column) -> Column:
    """Integer part of a number, or null: `12.0` is 12."""
    return F.trim(text.cast("string")).try_cast("double").try_cast("int")


def to_double(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast("double")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """Text of a pattern's group, or null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def lower_trim(text: Column) -> Column:
    return F.lower(F.trim(text))


def upper_trim(text: Column) -> Column:
    return F.upper(F.trim(text))


def fold_accents(text: Column) -> Column:
    """Without the accents of lower-case letters."""
    return F.translate(text, ACCENTED, PLAIN)


def norm_name(text: Column) -> Column:
    """Letters and digits of a name in lower case, without accents, spaces and marks: the key names are compared by."""
    return F.regexp_replace(fold_accents(F.lower(text)), "[^a-z0-9]", "")


def last_name_key(text: Column) -> Column:
    return norm_name(F.regexp_extract(text, "(^| )([^ ]+)$", 2))


def first_letters_key(text: Column, n: int = 2) -> Column:
    """The first letters of what a name begins with; null if that isn't an ASCII letter or digit."""
    return F.substring(norm_name(first_match(text, "^([A-Za-z0-9]+)", 1)), 1, n)


def height_cm(text: Column) -> Column:
    """`6-7` (feet-inches) in centimetres."""
    parts = F.split(text, "-")
    inches = 12 * F.element_at(parts, 1).try_cast("double") + F.get(parts, F.lit(1)).try_cast("double")
    return F.when(text.rlike("^[0-9]+-[0-9]+$"), F.round(CM_PER_INCH * inches).cast("int"))


def weight_kg(text: Column) -> Column:
    """The leading digits, pounds, in kilograms."""
    return F.round(KG_PER_LB * F.try_to_number(first_match(text, "^[0-9]+"), F.lit("999999")).cast("double")).cast("int")


def percent_scale(share: Column) -> Column:
    """Shares up to 1 as percent, others as they are, to one digit."""
    return F.round(F.when(share <= 1, 100.0 * share).otherwise(share), 1)


def tolerant_date(text: Column) -> Column:
    """The date as written: the first ten characters if they are one, else the date of a timestamp."""
    text = F.trim(text.cast("string"))
    head = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))
    return F.coalesce(head, text.try_cast("timestamp").try_cast("date"))


def season_of(season: Column, date: Column | None = None, first_month: int = 7) -> Column:
    """Year a season starts in: the season itself, its first four characters, else from the date."""
    text = season.cast("string")
    known = F.coalesce(to_int(text), F.substring(text, 1, 4).try_cast("int"))
    return known if date is None else F.coalesce(known, season_of_date(date, first_month))


def season_of_date(date: Column, first_month: int = 7) -> Column:
    return F.when(F.month(date) >= first_month, F.year(date)).otherwise(F.year(date) - 1)


def season_label(season: Column) -> Column:
    """2019 -> `2019-20`."""
    year = to_int(season)
    return F.concat(year.cast("string"), F.lit("-"), F.right((year + 1).cast("string"), F.lit(2)))


def number_with_commas(text: Column) -> Column:
    return F.replace(text.cast("string"), F.lit(","), F.lit("")).try_cast("double")


def attendance(text: Column) -> Column:
    """Head count from text: commas and white space don't count; `1234.567` and `1.234.567` are by thousands, `19,234.0` loses its fraction."""
    bare = F.regexp_replace(text.cast("string"), r"[,\s]", "")
    digits = F.regexp_replace(bare, "[^0-9]", "")
    whole = F.when(bare.rlike(r"^\d+(\.\d{3})+$"), digits).when(bare.rlike(r"^\d+\.\d+$"), F.substring_index(bare, ".", 1)).otherwise(digits)
    return F.nullif(whole, F.lit("")).try_cast("int")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_infinity(a: Column, b: Column) -> Column:
    """a / b as floating-point numbers divide: infinite where b is 0, NaN where both are."""
    return F.coalesce(safe_ratio(a, b), a.cast("double") * F.pow(b.cast("double"), -1))


def round_scaled(value: Column, digits: int) -> Column:
    """A double rounded by its product with 10**digits, as SQL engines do that round doubles without decimals; `round` takes its shortest decimal form."""
    scale = 10.0**digits
    scaled = value * scale
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / scale).otherwise(value)


def least_known(*values: Column) -> Column:
    """The least value; null if any is null."""
    any_null = values[0].isNull()
    for v in values[1:]:
        any_null |= v.isNull()
    return F.when(~any_null, F.least(*values))


def clamp01(value: Column, scale: float = 1.0) -> Column:
    """value / scale within 0 and 1; null: 0."""
    return F.greatest(F.least(F.coalesce(value / F.lit(float(scale)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def ramp(value: Column, low: float, high: float) -> Column:
    """0 up to `low`, 1 from `high` on, linear between; null: 0."""
    return clamp01(value - F.lit(float(low)), high - low)


def per_36(points: Column, minutes: Column) -> Column:
    return F.when(minutes > 0, points / minutes * 36.0)


def per_game(total: Column, games: Column) -> Column:
    return F.round(safe_ratio(total, games), 1)


def made_percent(made: Column, tried: Column) -> Column:
    return F.round(100.0 * safe_ratio(made, tried), 1)


def effective_percent(made: Column, threes: Column, tried: Column) -> Column:
    return F.round(100.0 * safe_ratio(made + 0.5 * threes, tried), 1)


def nickname(team: Column) -> Column:
    """Last word of a team's name; `trail blazers` are two."""
    name = F.trim(team)
    two = F.lower(name).endswith("trail blazers")
    return F.when(two, F.right(name, F.lit(len("trail blazers")))).otherwise(F.element_at(F.split(name, r"\s+"), -1))


def date_prefix(text: Column) -> Column:
    return F.substring(text.cast("string"), 1, 10)


def typed(struct: StructType) -> list[Column]:
    """Columns of a text table as the types of `struct`; what doesn't parse is null."""
    out = []
    for f in struct.fields:
        kind = to_int_loose(F.col(f.name)) if isinstance(f.dataType, IntegerType) else to_double(F.col(f.name)) if isinstance(f.dataType, DoubleType) else F.col(f.name).cast(f.dataType)
        out.append(kind.alias(f.name))
    return out


def several_teams(team: Column) -> Column:
    """Whether a team code stands for several teams of a season, such as 2TM."""
    return upper_trim(team).rlike("^[0-9]+TM$")


def tool_name(text: Column) -> Column:
    """Benchmark tools by one name each: pyspark, hadoop, else the text in lower case."""
    name = lower_trim(text)
    return F.when(name.contains("spark"), "pyspark").when(name.contains("hadoop"), "hadoop").otherwise(name)


def format_name(text: Column) -> Column:
    name = lower_trim(text)
    return F.when(name.contains("parquet"), "parquet").when(name.contains("tsv") | name.contains("csv") | name.contains("text"), "tsv").otherwise(name)
