"""Dates written as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import let

# The accepted spellings and their formats, month before day where the text leaves it
# open. A text is parsed only by the formats whose shape it has, because a failed parse is slow.
DATE_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$", "MM/dd/yyyy HH:mm:ss"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4} \d{2}:\d{2}:\d{2}$", "MMM d, yyyy HH:mm:ss"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}$", "dd.MM.yyyy HH:mm:ss"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"),
)


def parse_date(text: Column, formats: Sequence[tuple[str, str]] = DATE_FORMATS) -> Column:
    """The timestamp (without zone) by the format of the text's shape; null when there is none."""
    trimmed = F.trim(text)
    return F.coalesce(
        *[F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit(f)).cast("timestamp_ntz")) for shape, f in formats]
    )


def date_text(timestamp: Column) -> Column:
    """``dd/MM/yyyy HH:mm:ss``."""
    return F.date_format(timestamp, "dd/MM/yyyy HH:mm:ss")


# --- free spelling --------------------------------------------------------------------------------

# Names of the months and of the days, and words and zones that stand in dates.
MONTHS = (
    "january januar janvier enero gennaio janeiro januari января январь",
    "february februar février fevrier febrero febbraio fevereiro februari февраля февраль",
    "march märz maerz mrz mars marzo março marco maart марта март",
    "april avril abril aprile апреля апрель",
    "may mai mayo maggio maio mei мая май",
    "june juni juin junio giugno junho июня июнь",
    "july juli juillet julio luglio julho июля июль",
    "august août aout agosto augustus августа август",
    "september septembre septiembre settembre setembro сентября сентябрь",
    "october oktober octobre octubre ottobre outubro октября октябрь",
    "november novembre noviembre novembro ноября ноябрь",
    "december dezember décembre decembre diciembre dicembre dezembro декабря декабрь",
)
DAYS = (
    "monday montag lundi lunes lunedì segunda maandag понедельник tuesday dienstag mardi martes martedì terça dinsdag вторник "
    "wednesday mittwoch mercredi miércoles mercoledì quarta woensdag среда thursday donnerstag jeudi jueves giovedì quinta donderdag четверг "
    "friday freitag vendredi viernes venerdì sexta vrijdag пятница saturday samstag samedi sábado sabato zaterdag суббота "
    "sunday sonntag dimanche domingo domenica zondag воскресенье"
)
FILLERS = "t st nd rd th of the on at and de del den der am um uhr le à las a alle г года в"
ZONES = "z|utc|gmt|est|edt|cst|cdt|mst|mdt|pst|pdt|cet|cest|bst|msk"
SHORTEST_NAME = 3
# Two-digit years from here on are of the 1900s.
PIVOT_YEAR = 69

_CLOCK = rf"(?<!\d)(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,6}})\d*)?)?(?:\s*([ap])\.?m\b\.?)?(?:\s*(?:(?:{ZONES})\b)?\s*(?:[+-]\d{{2}}:?\d{{2}}\b)?)"
_HOUR = r"(?<!\d)(\d{1,2})\s*([ap])\.?m\b\.?"


def _prefixes(names: str) -> set[str]:
    return {name[:n] for name in names.split() for n in range(min(SHORTEST_NAME, len(name)), len(name) + 1)}


def _name_classes() -> dict[str, str]:
    """Class of a word: M and the month for a name or a beginning of names of that month only, nothing for other known words."""
    of: dict[str, set[int]] = {}
    for number, names in enumerate(MONTHS, 1):
        for prefix in _prefixes(names):
            of.setdefault(prefix, set()).add(number)
    classes = dict.fromkeys([*_prefixes(DAYS), *FILLERS.split()], "")
    return classes | {word: f"M{min(numbers)}" if len(numbers) == 1 else "x" for word, numbers in of.items()}


def _parts(text: Column) -> Column:
    """shape (a letter per token), numbers, clock and separator of a spelling, for the grammar below."""
    low = F.lower(F.trim(text))
    classes = _name_classes()
    known = F.create_map(*[F.lit(x) for pair in sorted(classes.items()) for x in pair])
    timed, hour = low.rlike(_CLOCK), low.rlike(_HOUR)
    # A dot or comma in a time would be a separator of the date: the time goes first.
    day = F.when(timed, F.regexp_replace(low, _CLOCK, " ")).when(hour, F.regexp_replace(low, _HOUR, " ")).otherwise(low)
    tokens = F.regexp_extract_all(day, F.lit(r"(\p{L}+|\d+)"), F.lit(1))

    def kind(token: Column) -> Column:
        number = F.when(F.length(token) <= 2, "n").when(F.length(token) == 4, "Y").when(F.length(token) == 8, "C").when(F.length(token) == 10, "E").when(F.length(token) == 13, "L")
        return F.when(token.rlike(r"^\d"), F.coalesce(number, F.lit("x"))).otherwise(F.coalesce(F.try_element_at(known, token), F.lit("x")))

    kinds = F.transform(tokens, kind)
    shape = F.array_join(F.transform(kinds, lambda k: F.substring(k, 1, 1)), "")
    # Anything else than these between the tokens is not a date.
    plain = day.rlike(r"^[\p{L}\d\s,./'’\-]*$")
    name = F.array_max(F.filter(kinds, lambda k: k.startswith("M")))
    half = F.when(timed, F.regexp_extract(low, _CLOCK, 5)).otherwise(F.regexp_extract(low, _HOUR, 2))
    told = F.when(timed, F.regexp_extract(low, _CLOCK, 1)).when(hour, F.regexp_extract(low, _HOUR, 1)).otherwise("0").try_cast("int")
    of_day = F.when(half == "", told).when((told >= 1) & (told <= 12), told % 12 + F.when(half == "p", 12).otherwise(0))

    def of_clock(group: int) -> Column:
        return F.coalesce(F.regexp_extract(low, _CLOCK, group).try_cast("int"), F.lit(0))

    fraction = F.concat(F.lit("0."), F.regexp_extract(low, _CLOCK, 4), F.lit("0")).try_cast("decimal(8,6)")
    return F.struct(
        F.when(plain, shape).alias("shape"),
        F.transform(F.filter(tokens, lambda x: x.rlike(r"^\d")), lambda x: x.try_cast("long")).alias("numbers"),
        F.transform(F.filter(tokens, lambda x: x.rlike(r"^\d")), F.length).alias("digits"),
        F.substring(name, 2, 2).try_cast("int").alias("month"),
        of_day.alias("hour"),
        of_clock(2).alias("minute"),
        (of_clock(3) + F.when(timed, fraction).otherwise(0)).cast("decimal(8,6)").alias("second"),
        day.rlike(r"\d\s*\.\s*\d{1,2}\s*\.").alias("dotted"),
    )


def _first_is_day(parts: Column, day_first: Column) -> Column:
    """Of two small numbers: by a value above 12, by dots between them, else as the column has it."""
    first, second = F.get(parts["numbers"], 0), F.get(parts["numbers"], 1)
    return F.when(first > 12, True).when(second > 12, False).otherwise(parts["dotted"] | day_first)


def _from_parts(p: Column, day_first: Column, year: Column) -> Column:
    def number(at: int) -> Column:
        return F.get(p["numbers"], at)

    def full(at: int) -> Column:
        century = F.when(number(at) >= PIVOT_YEAR, 1900).otherwise(2000)
        return F.when(F.get(p["digits"], at) <= 2, number(at) + century).otherwise(number(at))

    def moment(y: Column, m: Column, d: Column) -> Column:
        return F.try_make_timestamp_ntz(y.cast("int"), m.cast("int"), d.cast("int"), p["hour"], p["minute"], p["second"])

    shape, month, one = p["shape"], p["month"], F.lit(1)
    first_is_day = _first_is_day(p, day_first)
    epoch = F.timestamp_micros(number(0) * F.when(shape == "E", 1_000_000).otherwise(1_000))
    packed = number(0)
    return (
        F.when(shape == "Ynn", moment(number(0), number(1), number(2)))
        .when(shape.isin("nnY", "nnn") & first_is_day, moment(full(2), number(1), number(0)))
        .when(shape.isin("nnY", "nnn"), moment(full(2), number(0), number(1)))
        .when(shape.isin("nMY", "nMn", "MnY", "Mnn"), moment(full(1), month, number(0)))
        .when(shape == "YMn", moment(number(0), month, number(1)))
        .when(shape.isin("MY", "YM"), moment(number(0), month, one))
        .when(shape.isin("nM", "Mn"), moment(year, month, number(0)))
        .when(shape == "C", moment(F.floor(packed / 10_000), F.floor(packed / 100) % 100, packed % 100))
        .when(shape.isin("E", "L"), F.to_timestamp_ntz(F.date_format(epoch, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))
    )


def free_date(text: Column, day_first: Column | bool = False, year: int | None = None) -> Column:
    """The timestamp (without zone) of a freely spelled date, null where it cannot be read.

    Numbers, month names or their beginnings in eight languages, day names, a clock with or without am or pm, and a
    zone, which is read over: the time stays as written. Seconds or milliseconds since 1970 are read in the session's
    time zone. Of two numbers that can both be a month, dots between them make the first the day, else ``day_first``
    decides. A missing day is the first, a missing year is ``year``, without it the text is not read. Words counted
    from today ("yesterday") are not read, as the result would change with the day.
    """
    order = day_first if isinstance(day_first, Column) else F.lit(day_first)
    return let(_parts(text), lambda p: _from_parts(p, order, F.lit(year).cast("int")))


def day_comes_first(df: DataFrame, text: str) -> Column:
    """Whether more of the dates that tell their order by a number above 12 begin with the day, over the whole column."""
    parts = df.select(_parts(F.col(text)).alias("p")).where(F.col("p.shape").isin("nnY", "nnn"))
    first, second = F.get("p.numbers", 0), F.get("p.numbers", 1)
    votes = F.count_if((first > 12) & (second <= 12)) > F.count_if((second > 12) & (first <= 12))
    return parts.agg(votes).scalar()


def with_free_dates(df: DataFrame, text: str, output: str, year: int | None = None) -> DataFrame:
    """Add the timestamps of a text column whose order of day and month is decided from the whole column."""
    decided = df.withColumn("_day_first", day_comes_first(df, text))
    return decided.withColumn(output, free_date(F.col(text), F.col("_day_first"), year)).drop("_day_first")


def unread_share(df: DataFrame, text: str, output: str) -> DataFrame:
    """(texts, unread, share): of the texts that are not blank, those without a timestamp."""
    texts = df.where(F.trim(text) != "")
    counts = texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col(output).isNull()).alias("unread"))
    return counts.withColumn("share", F.when(F.col("texts") > 0, F.col("unread") / F.col("texts")).otherwise(0.0))


# --- ISO dates ------------------------------------------------------------------------------------

# Fixed pattern: ISO 8601 date, optional time, optional zone offset.
ISO_DATE = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?(Z|[+-]\d{2}:\d{2})?$"


def is_iso_date(text: Column) -> Column:
    day = F.regexp_extract(text, ISO_DATE, 1)
    clock = F.regexp_extract(text, ISO_DATE, 2)
    return (
        text.rlike(ISO_DATE)
        & F.try_to_date(day, "yyyy-MM-dd").isNotNull()
        & ((clock == "") | clock.rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?$"))
    )


def rfc3339(text: Column) -> Column:
    """ISO date text as RFC 3339: midnight and ``Z`` where the time or zone is absent; null when unreadable."""
    day = F.regexp_extract(text, ISO_DATE, 1)
    clock = F.regexp_extract(text, ISO_DATE, 2)
    zone = F.regexp_extract(text, ISO_DATE, 3)
    clock = (
        F.when(clock == "", F.lit("00:00:00"))
        .when(F.length(clock) == 5, F.concat(clock, F.lit(":00")))
        .when(clock.contains("."), F.rpad(clock, 15, "0"))
        .otherwise(clock)
    )
    zone = F.when(zone.isin("", "Z"), F.lit("Z")).otherwise(zone)
    return F.when(is_iso_date(text), F.concat(day, F.lit("T"), clock, zone))
