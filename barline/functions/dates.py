"""Trade dates in any usual spelling, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.numeric import once
from barline.schema import DateFormat

#: White space, and the other characters that may stand between year, month and day.
_BLANKS, _MARKS = " \t\n\x0b\f\r", "./-"
#: Spellings by format; dates and timestamps keep their type.
SPELLINGS = {
    DateFormat.PURE_NUM: "yyyyMMdd",
    DateFormat.HYPHEN: "yyyy-MM-dd",
    DateFormat.SLASH: "yyyy/MM/dd",
    DateFormat.DOT: "yyyy.MM.dd",
    DateFormat.CHINESE: "yyyy年MM月dd日",
    DateFormat.HYPHEN_DATETIME: "yyyy-MM-dd HH:mm:ss",
    DateFormat.SLASH_DATETIME: "yyyy/MM/dd HH:mm:ss",
    DateFormat.CHINESE_DATETIME: "yyyy年MM月dd日 HH时mm分ss秒",
}


def today() -> Column:
    """Today's date in Shanghai (UTC+8), whatever the session's time zone."""
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("Asia/Shanghai"), F.current_timestamp().cast("timestamp_ntz")))


def _is_number(text: Column, least: int, most: int) -> Column:
    """Whether a text is least to most digits, and nothing else."""
    return F.length(text).between(least, most) & (F.translate(text, "0123456789", "") == "")


def _from(text: Column, start: int | Column) -> Column:
    """The text from its start-th character on."""
    return F.substr(text, F.lit(start) if isinstance(start, int) else start)


def _day(text: Column, plain: Column) -> Column:
    """struct(month, day, rest) of what follows a year; plain: the same with each mark as one space.

    Month and day are two runs of digits with one mark between them, or one run: the day is what its first two digits leave, or,
    of a run of two, the second one.
    """

    def split(runs: Column) -> Column:
        first, second = F.get(runs, F.lit(0)), F.get(runs, F.lit(1))
        two = (F.length(first) <= 2) & (F.coalesce(second, F.lit("")) != "")
        month = F.when(two, first).otherwise(F.left(first, F.greatest(F.lit(1), F.least(F.lit(2), F.length(first) - 1))))
        day = F.when(two, second).otherwise(_from(first, F.length(month) + 1))
        return F.struct(month.alias("month"), day.alias("day"), _from(text, F.length(first) + F.when(two, F.length(second) + 1).otherwise(0) + 1).alias("rest"))

    return once(F.split(plain, " ", 3), split)


def _time(rest: Column) -> Column:
    """Hour, minute and second as an array of texts, of what follows a day: nothing, or blanks and a time; null if it is neither.

    A colon may stand after the hour and after the minute; without one, each takes two digits.
    """

    def read(parts: Column) -> Column:
        first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
        cut = F.when(F.size(parts) == 1, F.array(F.left(first, F.lit(2)), F.substr(first, F.lit(3), F.lit(2)), _from(first, 5)))
        cut = cut.when((F.size(parts) == 2) & (F.length(first) <= 2), F.array(first, F.left(second, F.lit(2)), _from(second, 3)))
        cut = cut.when(F.size(parts) == 2, F.array(F.left(first, F.lit(2)), _from(first, 3), second))
        return cut.when(F.size(parts) == 3, F.array(first, second, third))

    bare = F.ltrim(F.translate(rest, _BLANKS, " " * len(_BLANKS)))
    return F.when(rest == "", F.array(F.lit("0"), F.lit("0"), F.lit("0"))).when(F.length(bare) < F.length(rest), once(F.split(bare, ":"), read))


def parse_trade_date(text: Column) -> Column:
    """A timestamp without time zone; null if the text isn't a date. A null or blank text is today.

    A date is a year of four digits, a month and a day of one or two, with one mark (a blank, dot, slash or hyphen) or none after the
    year and the month; after blanks a time may follow, whose minutes and seconds can be missing.
    """

    def read(text: Column) -> Column:
        plain = F.translate(text, _BLANKS + _MARKS, " " * len(_BLANKS + _MARKS))
        skip = F.when(F.substr(plain, F.lit(5), F.lit(1)) == " ", 6).otherwise(5)
        found = once(_day(_from(text, skip), _from(plain, skip)), lambda day: once(_time(day["rest"]), lambda time: moment(F.left(text, F.lit(4)), day, time)))
        return F.when(text.isNull() | (text == ""), today().cast("timestamp_ntz")).otherwise(found)

    def moment(year: Column, day: Column, time: Column) -> Column:
        hour, minute, second = (F.get(time, F.lit(i)) for i in range(3))
        written = _is_number(year, 4, 4) & _is_number(day["month"], 1, 2) & _is_number(day["day"], 1, 2) & _is_number(hour, 1, 2) & _is_number(minute, 0, 2) & _is_number(second, 0, 2)
        whole = [F.when(x != "", x).otherwise("0").cast("int") for x in (year, day["month"], day["day"], hour, minute, second)]
        return F.when(written, F.try_make_timestamp_ntz(*whole))

    return once(F.trim(text.cast("string")), read)


def normalize_trade_date(text: Column, form: str | None = DateFormat.HYPHEN) -> Column:
    """The date in a form, null if it isn't one; without a form, a struct of all forms and error."""

    def formed(moment: Column) -> Column:
        forms = {name: F.date_format(moment, spelling) for name, spelling in SPELLINGS.items()}
        forms |= {DateFormat.DATE_CLASS: F.to_date(moment), DateFormat.DATETIME_CLASS: moment}
        if form:
            return forms[form]
        error = F.when(moment.isNull(), F.concat(F.lit("not a date: "), text.cast("string")))
        return F.struct(*[column.alias(str(name)) for name, column in forms.items()], error.alias("error"))

    return once(parse_trade_date(text), formed)
