"""Text rules as column expressions: white space, numbers, names, ids. All stay inside the JVM.

Rules follow the semantics of the scripts whose results they must match: white space includes no-break spaces and the
byte order mark, ``$`` is the end of the input only, case folding covers Cyrillic, numbers are read from a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

#: The same as characters, and as a class for texts without characters from U+1680 on, which is tested far faster.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NEAR_WS = r"[\t\n\x0B\f\r \xA0]"

#: Litres, grams or themselves per historical unit (fixed values).
UNIT_FACTORS = {
    "штоф": 1.23, "золотник": 4.266, "фунт": 409.5, "ведро": 12.3, "бутыль": 0.75, "стакан": 0.25, "чарка": 0.123,
    "лот": 12.8, "пуд": 16380.0, "литр": 1.0, "л": 1.0, "грамм": 1.0, "г": 1.0,
}

#: Cyrillic letters in Latin (fixed values); the hard and soft signs stay.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "j",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "shch", "ы": "y", "э": "e", "ю": "yu", "я": "ya",
}


def trim_all(c: Column) -> Column:
    """Strip all white space at both ends, line ends included."""
    return F.btrim(c, F.lit(SPACES))


def bound(c: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def by_space(c: Column, f) -> Column:
    """``f(white space class)``: the short class where the text has no space beyond it."""
    return F.when(c.rlike("[\u1680-\ufeff]"), f(WS)).otherwise(f(NEAR_WS))


def collapse(c: Column) -> Column:
    return by_space(c, lambda ws: F.regexp_replace(c, rf"{ws}++", " "))


def prefix_number(c: Column) -> Column:
    """The number that the text begins with; null where there is none."""
    return F.regexp_extract(c, rf"\A{WS}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def historical_number(c: Column) -> Column:
    """``1 1/2`` to 1.5, ``3/4`` to 0.75, else the number in front, else 0. A zero denominator gives null."""
    mixed, simple = rf"(\d+){WS}+(\d+)/(\d+)", r"(\d+)/(\d+)"

    def read(t: Column) -> Column:
        part = lambda p, k: F.regexp_extract(t, p, k).try_cast("double")
        return (
            F.when(t.rlike(mixed), part(mixed, 1) + F.try_divide(part(mixed, 2), part(mixed, 3)))
            .when(t.rlike(simple), F.try_divide(part(simple, 1), part(simple, 2)))
            .otherwise(F.coalesce(prefix_number(t), F.lit(0.0)))
        )

    return bound(trim_all(F.coalesce(c, F.lit(""))), read)


def decimal_comma(c: Column) -> Column:
    """A number whose first comma is the decimal point; null where none can be read."""
    return prefix_number(F.regexp_replace(c, r"\A([^,]*),", "$1."))


def clean_name(c: Column) -> Column:
    """A list item's name: lower case, no closing punctuation, leading dash, quality word, brackets or rough amount."""
    t = F.lower(F.coalesce(c, F.lit("")))
    for pattern, put in (
        (r"[,;.()!]+\z", ""),
        (rf"\A{WS}*-{WS}*", ""),
        (rf"{WS}+", " "),
        (rf"\A(?:свежей?|сухой?|молотой?|целой?|мелкой?|лучшей?){WS}+", ""),
        (rf"{WS}+(?:свежий|сухой|молотый|целый|мелкий|лучший)\z", ""),
        (rf"{WS}*\([^\n\r\u2028\u2029]*?\){WS}*", ""),
        (rf"\A([\s\S]*?)около{WS}*[\d,]+{WS}*[гл]", "$1"),
    ):
        t = F.regexp_replace(t, pattern, put)
    return trim_all(t)


def convert_unit(amount: Column, unit: Column) -> Column:
    """Amount times the unit's factor; null for a unit without one."""
    factors = F.create_map(*[x for k, v in UNIT_FACTORS.items() for x in (F.lit(k), F.lit(v))])
    return amount * F.try_element_at(factors, unit)


def transliterate(c: Column) -> Column:
    """Lower-cased, Cyrillic letters in Latin."""
    t = F.lower(c)
    single = {k: v for k, v in LATIN.items() if len(v) == 1}
    t = F.translate(t, "".join(single), "".join(single.values()))
    for k, v in LATIN.items():
        if len(v) > 1:
            t = F.replace(t, F.lit(k), F.lit(v))
    return t


def match_id(c: Column) -> Column:
    """The form in which ids are compared."""
    return F.regexp_replace(transliterate(trim_all(c)), "_+", "_")


def positional_similarity(a: Column, b: Column) -> Column:
    """Share of the longer text's places that hold the same character in both; 1 for two empty texts."""
    low, high = F.least(F.char_length(a), F.char_length(b)), F.greatest(F.char_length(a), F.char_length(b))
    places = F.when(low > 0, F.sequence(F.lit(1), low)).otherwise(F.array().cast("array<int>"))
    same = F.size(F.filter(places, lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    return F.when(high == 0, F.lit(1.0)).otherwise(F.try_divide(same.cast("double"), high))


def truncate_at_word(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut at the last space if that is beyond nine tenths of them, then an ellipsis."""
    head = F.substring(c, 1, most)
    space = F.when(F.instr(head, " ") > 0, F.lit(most) - F.instr(F.reverse(head), " ")).otherwise(F.lit(-1))
    cut = F.when(space > 0.9 * most, F.substr(head, F.lit(1), space)).otherwise(head)
    return F.when(F.char_length(c) <= most, c).otherwise(F.concat(cut, F.lit("...")))


def embedding_input(template: str, parts: list[Column], most: int = 16_000) -> dict[str, Column]:
    """The text that a model embeds, and what became of it: ``template`` with a ``%s`` for each part (null counts as empty), cut at a word."""
    full = F.format_string(template, *[F.coalesce(p, F.lit("")) for p in parts])
    cut = truncate_at_word(full, most)
    return {"embedding_text": cut, "was_truncated": F.char_length(full) > most, "original_length": F.char_length(full), "embedding_length": F.char_length(cut)}


#: The template of records (a fixed value).
RECORD_TEMPLATE = "Рецепт: %s\n\nСодержание: %s"


def plain_number(c: Column) -> Column:
    """A number as text without a needless fraction: 3, 51.2."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def contains_any(c: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def term_count(c: Column, term: str) -> Column:
    """Occurrences of a term, taken literally and not overlapping."""
    return ((F.char_length(c) - F.char_length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def word_list(c: Column) -> Column:
    """The text split at white space, as a script's ``split`` does it: leading and trailing space give empty words."""
    return by_space(c, lambda ws: F.split(c, rf"{ws}++", -1))


def first_nonempty(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


#: Name to category by the first term that it holds (fixed values).
CATEGORIES = (
    ("эссенция", ("эссенция", "квинтэссенция")), ("эликсир", ("эликсир",)), ("тинктура", ("тинктура",)), ("жизненные_капли", ("капли", "жизненные")),
)


def elixir_category(name: Column, short: bool = False) -> Column:
    n = F.lower(name)
    out = F.when(contains_any(n, list(CATEGORIES[0][1])), CATEGORIES[0][0])
    for value, terms in CATEGORIES[1 : 3 if short else 4]:
        out = out.when(contains_any(n, list(terms)), value)
    if not short:
        out = out.when(n.contains("вода") & ~n.contains("раневая"), "лечебная_вода")
    return out.otherwise("настойка")


def family_category(name: Column) -> Column:
    """First of three families that the name tells, else other."""
    n = F.lower(name)
    return F.when(n.contains("водк"), "водка").when(n.contains("розоли"), "розолия").when(n.contains("ратафи"), "ратафия").otherwise("другое")


def liqueur_category(content: Column, name: Column) -> Column:
    return F.when(F.lower(content).contains("ликёр") | F.lower(name).contains("ликёр"), "ликёр").otherwise("водка")


def volume_and_strength(c: Column) -> tuple[Column, Column]:
    """The first volume and strength that a description tells; null where absent. A decimal comma is not read."""
    number = r"(\d+(?:\.\d+)?)"
    volume = F.regexp_extract(c, rf"(?iu){number}{WS}*(?:дкл|л)", 1)
    strength = F.regexp_extract(c, rf"(?iu){number}{WS}*°?{WS}*(?:по{WS}+)?Траллесу", 1)
    return volume.try_cast("double"), strength.try_cast("double")
