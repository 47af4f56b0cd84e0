"""Names of products as columns: normal forms, volumes, forms, brands, variants. No Python runs on the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that the results depend on.
BRACKET = r"[\[\(【][^\]\)】]*[\]\)】]"
PROMO = r"(?U)(기획|한정|단독|증정|사은품|리필|본품|세트|특가|할인|무료배송|택1|\d+\s*\+\s*\d+)"
VOLUME = r"(?U)(\d+(?:\.\d+)?)\s*(ml|mL|ML|g|G|호|매|개|정|캡슐|포)\b"
NOT_WORD = r"[^0-9A-Za-z가-힣]+"
LISTING = r"(?U)[0-9]+\s*종|[0-9]+\s*[Cc]olors?|[0-9]+\s*가지|[0-9]+\s*호|기획\s*/\s*단품|단품\s*/\s*기획|기획\s*/\s*본품|본품\s*/\s*기획|택\s*[0-9]"
FORMS = [
    ("sun", ["선크림", "선스틱", "선에센스", "선세럼", "선쿠션", "썬크림", "sun"]),
    ("cleanser", ["클렌징오일", "클렌징폼", "클렌징워터", "클렌저", "클렌징", "폼"]),
    ("mask", ["마스크", "팩시트", "시트팩", "팩"]),
    ("ampoule", ["앰플"]),
    ("serum", ["세럼", "에센스"]),
    ("toner", ["토너", "스킨"]),
    ("lotion", ["로션", "에멀전"]),
    ("cream", ["크림"]),
    ("tint", ["틴트", "립스틱", "립글로스"]),
    ("cushion", ["쿠션"]),
    ("shampoo", ["샴푸", "트리트먼트", "컨디셔너"]),
    ("bodywash", ["바디워시", "샤워젤"]),
    ("perfume", ["퍼퓸", "오드퍼퓸", "edp", "edt", "향수"]),
    ("mist", ["미스트"]),
    ("gel", ["젤"]),
    ("balm", ["밤"]),
    ("oil", ["오일"]),
    ("powder", ["파우더"]),
]
#: An enumeration has at least so many items.
MIN_ITEMS = 3


def normalised_name(name: Column) -> Column:
    """Lower-case words without brackets, promotions and volumes; null becomes ''."""
    spaced = reduce(lambda c, pattern: F.regexp_replace(c, pattern, " "), [BRACKET, PROMO, VOLUME, NOT_WORD], F.coalesce(name, F.lit("")))
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def volume(name: Column) -> Column:
    """struct<amount: double, unit: string> of the first volume, or null."""
    digits = F.translate(F.regexp_extract(name, VOLUME, 1), "０１２３４５６７８９", "0123456789")
    number = F.when(digits != "", digits).try_cast("double")
    return F.when(number.isNotNull(), F.struct(number.alias("amount"), F.lower(F.regexp_extract(name, VOLUME, 2)).alias("unit")))


def product_volume(own: Column, name: Column) -> Column:
    """The volume of its own column, else that in the name."""
    return F.coalesce(volume(own), volume(name))


def product_form(name: Column) -> Column:
    """The first form, in the order of FORMS, of which the name has a word; '' if it has none."""
    tight = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), " ", "")
    out = None
    for form, words in FORMS:
        named = reduce(lambda a, b: a | b, [F.contains(tight, F.lit(w)) for w in words])
        out = F.when(named, form) if out is None else out.when(named, form)
    return out.otherwise("")


def normalised_brand(brand: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(brand, F.lit("")), NOT_WORD, ""))


def without_brand(norm: Column, brand: Column) -> Column:
    """norm without the leading words that spell the brand; never nothing, and unchanged where there is no brand."""
    words = F.split(norm, " ")
    spelt = F.filter(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), "") == brand)
    cut = F.coalesce(F.try_element_at(spelt, F.lit(1)), F.lit(0))
    rest = F.array_join(F.slice(words, cut + 1, F.greatest(F.size(words) - cut, F.lit(0))), " ")
    return F.when((F.coalesce(brand, F.lit("")) == "") | (F.coalesce(norm, F.lit("")) == "") | (rest == ""), norm).otherwise(rest)


def variants(name: Column) -> Column:
    """array<string> of what the first bracket that opens a list of at least MIN_ITEMS items enumerates; else empty.

    Brackets need not be closed or balanced: a list goes to the end of the name, less a closing bracket there.
    """
    text = F.coalesce(name, F.lit(""))
    none = F.array().cast("array<string>")
    opened = F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1))), lambda k: F.substring(text, k, F.lit(1)).isin("(", "（"))

    def items(k: Column) -> Column:
        tail = F.substring(text, k + 1, F.char_length(text))
        parts = F.split(F.regexp_replace(tail, r"(?U)[\)）]\s*$", ""), "[/,]")
        return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^[ ()（）]+|[ ()（）]+$", "")), lambda p: p != "")

    lists = F.filter(F.transform(opened, items), lambda found: F.size(found) >= MIN_ITEMS)
    return F.coalesce(F.try_element_at(lists, F.lit(1)), none)


def row_kind(name: Column) -> Column:
    """'listing' where the name says itself that it sells several variants, else 'sku'."""
    text = F.coalesce(name, F.lit(""))
    return F.when(text.rlike(LISTING) | (F.size(variants(name)) > 0), "listing").otherwise("sku")


def escaped_like(part: str) -> str:
    """A LIKE pattern for names that contain part; % and _ in it stand for themselves."""
    for c in "\\%_":
        part = part.replace(c, f"\\{c}")
    return f"%{part}%"


#: Answers that count as yes and no (fixed values).
YES = ["y", "yes", "1", "true", "o", "ㅇ"]
NO = ["n", "no", "0", "false", "x", "ㄴ"]


def stripped(text: Column) -> Column:
    """text without white space of any kind at its ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def label_answer(answer: Column) -> Column:
    """True, False or null for a filled-in answer."""
    given = F.lower(stripped(answer))
    return F.when(given.isin(YES), True).when(given.isin(NO), False)
