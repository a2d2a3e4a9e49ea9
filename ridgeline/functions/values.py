"""Column functions on single values: names, keys, dates, quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as fn


def canonical_words(text: Column, words: dict[str, str], suffixes: dict[str, str]) -> Column:
    """A normal form with each word, or its first known suffix, in its canonical spelling.

    A suffix counts when at least two letters stand before it, and then becomes a word.
    """
    known = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))

    def one(w: Column) -> Column:
        ends = [(F.length(w) > len(k) + 1) & w.endswith(k) for k in suffixes]
        made = [F.when(c, F.concat(F.left(w, F.length(w) - len(k)), F.lit(" " + v))) for c, (k, v) in zip(ends, suffixes.items())]
        return F.coalesce(known[w], *made, w)

    return F.array_join(F.transform(fn.words(text), one), " ")


def umlaut_forms(text: Column) -> Column:
    """Spellings of a name that an index holds: as it is, and with umlauts as two letters."""
    wide = text
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue")):
        wide = F.replace(wide, F.lit(a), F.lit(b))
    return F.array_distinct(F.array(text, wide))


def refs(text: Column) -> Column:
    """Numbers in a reference, with leading zeros dropped: ``B 028a.7`` has 28 and 7."""
    found = F.regexp_extract_all(text, F.lit("([0-9]+)"), 1)
    return F.transform(found, lambda n: F.coalesce(F.nullif(F.ltrim(n, F.lit("0")), F.lit("")), F.lit("0")))


def refs_agree(a: Column, b: Column) -> Column:
    """Whether references share a number, or, without numbers, have equal letters."""
    none = (F.size(refs(a)) == 0) & (F.size(refs(b)) == 0)
    plain = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.when(none, plain(a) == plain(b)).otherwise(F.arrays_overlap(refs(a), refs(b)))


def names_agree(a: Column, b: Column) -> Column:
    """``same`` for equal letters and digits, ``words`` if one's words hold the other's and numbers match."""
    wa, wb = fn.words(F.regexp_replace(F.lower(a), r"[^\p{L}\p{N}]+", " ")), fn.words(F.regexp_replace(F.lower(b), r"[^\p{L}\p{N}]+", " "))
    digits = lambda w: F.array_sort(F.array_distinct(F.filter(w, lambda x: x.rlike("[0-9]"))))
    within = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    some = (F.size(wa) > 0) & (F.size(wb) > 0)
    same = F.array_join(wa, "") == F.array_join(wb, "")
    return F.when(some & same, "same").when(some & within & (digits(wa) == digits(wb)), "words")


def article(value: Column) -> Column:
    """``language:title`` of an encyclopedia link or tag; null for other links, parts of pages and empty titles."""
    link = value.rlike("^https?://")
    fields = F.regexp_extract(value, r"^https?://([a-z0-9-]+)\.wikipedia\.org/wiki/([^?#]+)$", 1), F.regexp_extract(value, r"^https?://([a-z0-9-]+)\.wikipedia\.org/wiki/([^?#]+)$", 2)
    language = F.when(link, fields[0]).otherwise(F.regexp_extract(value, r"^([^:]*):(.*)$", 1))
    title = F.when(link, F.try_url_decode(F.replace(fields[1], F.lit("+"), F.lit("%2B")))).otherwise(F.regexp_extract(value, r"^([^:]*):(.*)$", 2))
    title = F.trim(F.replace(title, F.lit("_"), F.lit(" ")))
    good = language.rlike("^[a-z][a-z0-9-]*$") & (title != "") & ~title.contains("#")
    return F.when(good, F.concat_ws(":", language, title))


def hash_slot(text: Column, slots: int) -> Column:
    """The whole SHA-256 of a text modulo ``slots``, digit by digit, so that no number overflows."""
    digits = F.split(F.sha2(text, 256), "")
    digit = lambda h: F.conv(h, 16, 10).cast("long")
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, h: F.when(h == "", s).otherwise((s * 16 + digit(h)) % slots))


def season_day(date: Column) -> Column:
    """Struct ``season, index``: pairs of days since 1 September; 29 February counts as the 28th."""
    late = F.month(date) >= 9
    year = F.year(date) - F.when(late, 0).otherwise(1)
    day = F.when((F.month(date) == 2) & (F.dayofmonth(date) == 29), F.date_sub(date, 1)).otherwise(F.to_date(date))
    leap = F.dayofmonth(F.last_day(F.make_date(F.year(date), F.lit(2), F.lit(1)))) == 29
    days = F.datediff(day, F.make_date(year, F.lit(9), F.lit(1))) - F.when(leap & ~late & (F.month(date) >= 3), 1).otherwise(0)
    return F.struct(year.alias("season"), F.least(F.lit(182), F.floor(days / 2).cast("int")).alias("index"))


def quantised(value: Column) -> Column:
    """A height as a 16-bit whole number; null where it has none or does not fit."""
    n = F.round(value)
    return F.when(~F.isnan(value) & n.between(-32_767, 32_767), n.cast("short"))


def zigzag(n: Column) -> Column:
    """Whole numbers with small negative ones made small."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def varint_bytes(n: Column) -> Column:
    """Bytes of a number that is not negative, seven bits each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / 7)).cast("int")


def safe_sqrt(x: Column) -> Column:
    """Square root, null (not NaN) for negative numbers."""
    return F.when(x >= 0, F.sqrt(x))


def share_class(part: Column, known: Column) -> Column:
    """0 for none of the known, 1 to 4 by quarters, 5 for all, 6 where none is known."""
    quarters = F.when(4 * part >= 3 * known, 4).when(2 * part >= known, 3).when(4 * part >= known, 2).otherwise(1)
    return F.when(known == 0, 6).when(part == 0, 0).when(part == known, 5).otherwise(quarters)
