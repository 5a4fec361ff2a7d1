"""Column functions for names, addresses and dates. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS_PARTS = ("street_number", "street_name", "unit_number", "city", "state", "zipcode")


def collapse(text: Column) -> Column:
    """Surrounding white space goes; every inner run becomes one space."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", " ")


def standardize_address(part: Column, street_rule: bool = True) -> Column:
    """Collapsed, upper case, STREET and STR as words become ST, the empty string becomes null.

    Without `street_rule` street words stay as they are.
    """
    out = F.upper(collapse(part))
    if street_rule:
        out = F.regexp_replace(out, r"\b(STREET|STR)\b", "ST")
    return F.nullif(out, F.lit(""))


def joined(parts: Sequence[Column], sep: str = " ") -> Column:
    """Parts with a separator between them; a null part counts as the empty string."""
    return F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts])


def geokey(parts: Sequence[Column]) -> Column:
    """One key for an address; null if no part has anything."""
    return F.nullif(collapse(joined(parts)), F.lit(""))


def prefix(text: Column, k: int) -> Column:
    return F.substring(text, 1, k)


def parse_date(text: Column, fmt: str) -> Column:
    """A date; null where the text isn't one. `M/d/yyyy` also takes padded parts."""
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)))


def soundex_key(text: Column) -> Column:
    """Soundex of the text from its first letter on; null for null, empty without a letter."""
    letters = F.regexp_replace(F.upper(text), r"^[^A-Z]+", "")
    return F.soundex(letters)


def reverse_soundex(text: Column) -> Column:
    return soundex_key(F.reverse(text))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), then)[0]


def nysiis(text: Column) -> Column:
    """The NYSIIS code, as an expression; null for null, empty for empty.

    What a letter becomes depends on its neighbours in the name alone, so letters are mapped first and
    repeats are dropped afterwards.
    """
    return F.when(text.isNotNull(), _let(_let(_let(F.upper(text), _begin), _end), _code))


def _begin(u: Column) -> Column:
    begins = lambda *heads: F.rlike(u, F.lit(f"^({'|'.join(heads)})"))
    after = lambda put, n: F.concat(F.lit(put), F.substr(u, F.lit(n + 1)))
    return (
        F.when(begins("MAC"), after("MCC", 3)).when(begins("KN"), after("", 1)).when(begins("K"), after("C", 1))
        .when(begins("PH", "PF"), after("FF", 2)).when(begins("SCH"), after("SSS", 3)).otherwise(u)
    )


def _end(s: Column) -> Column:
    return F.when(F.rlike(s, F.lit("(IE|EE)$")), F.regexp_replace(s, "(IE|EE)$", "Y")).otherwise(F.regexp_replace(s, "(DT|RT|RD|NT|ND)$", "D"))


def _code(s: Column) -> Column:
    def coded(i: Column) -> Column:
        c, before, behind = F.substr(s, i, F.lit(1)), F.substr(s, i - 1, F.lit(1)), F.substr(s, i + 1, F.lit(1))
        vowel = lambda x: x.isin("A", "E", "I", "O", "U")
        # Letters that a pair or triple before them has taken; the first letter of a name takes none.
        taken = (
            ((i > 2) & (F.substr(s, i - 1, F.lit(2)) == "EV"))
            | ((i > 2) & (F.substr(s, i - 1, F.lit(2)) == "PH"))
            | ((i > 2) & (F.substr(s, i - 1, F.lit(3)) == "SCH"))
            | ((i > 3) & (F.substr(s, i - 2, F.lit(3)) == "SCH"))
        )
        return (
            F.when(taken, "")
            .when((c == "E") & (behind == "V"), "AF")
            .when(vowel(c), "A")
            .when(c == "Q", "G")
            .when(c == "Z", "S")
            .when(c == "M", "N")
            .when(c == "K", F.when(behind == "N", "N").otherwise("C"))
            .when((c == "S") & (F.substr(s, i + 1, F.lit(2)) == "CH"), "SS")
            .when((c == "P") & (behind == "H"), "F")
            .when((c == "H") & (~vowel(before) | ((behind != "") & ~vowel(behind))), F.when(vowel(before), "A").otherwise(before))
            .when((c == "W") & vowel(before), before)
            .otherwise(c)
        )

    letters = F.when(F.char_length(s) > 1, F.transform(F.sequence(F.lit(2), F.char_length(s)), coded)).otherwise(F.array().cast("array<string>"))
    key = F.aggregate(letters, F.substr(s, F.lit(1), F.lit(1)), lambda k, c: F.when((c == "") | (F.right(c, F.lit(1)) == F.right(k, F.lit(1))), k).otherwise(F.concat(k, c)))
    return _let(key, _trim)


def _trim(key: Column) -> Column:
    no_s = lambda k: F.when(k == "S", k).otherwise(F.regexp_replace(k, "S$", ""))
    no_a = lambda k: F.when(k == "A", k).otherwise(F.regexp_replace(k, "A$", ""))
    return _let(F.regexp_replace(no_s(key), "AY$", "Y"), no_a)


def initial_cut(name: Column) -> Column:
    """A-or-blank for null and A, U-Z for those letters, else the first character; null for the empty string."""
    first = F.substring(name, 1, 1)
    return F.when(name.isNull() | (first == "A"), "A-or-blank").when(name == "", None).when(first.isin(*"UVWXYZ"), "U-Z").otherwise(first)


def replace_values(text: Column, values: Mapping[str, str]) -> Column:
    """Whole values replaced by a dictionary; others become null."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), text) if pairs else F.lit(None).cast("string")
