"""Text functions as Spark columns. Digits of either Arabic script count as ASCII digits throughout."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Digit scripts, letter folds and marks, attachment kinds with file-name hints, clause periods.
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
FOLDS_FROM, FOLDS_TO = "أإآٱىة", "اااايه"
MARKS = "[\u0640\u064b-\u0652\u0670]"
NAME_BREAK = "[^0-9a-z\u0621-\u064a]+"
INVISIBLE = "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFEFF, 0x0640, *range(0x064B, 0x0653)]))
READ_FROM, READ_TO = "کیىأإآٱ", "كيياااا"
ATTACHMENTS = {
    "contract": ("Contract", ["contract", "عقد"]),
    "boq": ("Bill of Quantities", ["boq", "quantities", "كميات"]),
    "award letter": ("Award letter", ["award", "ترسية", "trseya"]),
    "work commencement": ("Work commencement minutes", ["commencement", "بدء", "مباشرة"]),
    "commercial registration": ("Commercial registration", ["commercial", "سجل", "registration"]),
    "zakat certificate": ("Zakat certificate", ["zakat", "زكاة", "زكاه"]),
    "gosi certificate": ("GOSI certificate", ["gosi", "تأمينات", "insurance"]),
}
EVERY_DAYS = r"(?i)(?:كل\s*(\d+)\s*(?:يوم|أيام|ايام)|every\s+(\d+)\s+days?)"
EACH_DAY = r"(?i)كل\s*(?:يوم|أيام|ايام)|يومي|باليوم|/\s*(?:يوم|اليوم)|per\s+day|daily"
EACH_WEEK = r"(?i)كل\s*(?:أسبوع|اسبوع)|أسبوعي|اسبوعي|/\s*(?:أسبوع|اسبوع)|per\s+week|weekly"
CODE_FROM, CODE_TO = r"^(\d+)\.(\d+)$", "0"


def bind(f, **values: Column) -> Column:
    """f(record of the values): they are worked out once, however often f uses them, and stand once in the plan."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), F.lit(0))


def ascii_digits(v: Column) -> Column:
    return F.translate(F.coalesce(v, F.lit("")), DIGITS_FROM, DIGITS_TO)


def digits(v: Column) -> Column:
    return F.regexp_replace(ascii_digits(v), "[^0-9]", "")


def ident_key(v: Column) -> Column:
    """An identifier without punctuation, spaces and case."""
    return F.upper(F.regexp_replace(ascii_digits(v), "[^0-9A-Za-z\u0600-\u06ff]+", ""))


def bidi_forms(v: Column) -> list[Column]:
    """The value and its forms with segments in reverse order, as right-to-left layout prints them."""
    v = F.coalesce(v, F.lit(""))
    return [v, *[F.array_join(F.reverse(F.split(v, sep, -1)), sep) for sep in "-/"]]


def bidi_variants(v: Column) -> Column:
    return F.array_distinct(F.array(*bidi_forms(v)))


@F.arrow_udf(StringType())
def nfkc(v: pa.Array) -> pa.Array:
    """Compatibility form; Spark has no function for it. ASCII texts are left alone."""
    other = pc.invert(pc.fill_null(pc.string_is_ascii(v), True))
    if not pc.any(other).as_py():
        return v
    return pc.replace_with_mask(v, other, pa.array([unicodedata.normalize("NFKC", x) for x in v.filter(other).to_pylist()], v.type))


def fold_name(v: Column) -> Column:
    """Lower case, folded letters, words parted by one space; of text in compatibility form."""
    plain = F.translate(F.regexp_replace(F.lower(ascii_digits(v)), MARKS, ""), FOLDS_FROM, FOLDS_TO)
    return F.trim(F.regexp_replace(plain, NAME_BREAK, " "))


def name_key(v: Column) -> Column:
    """What any correct reading of the same printed name or description has in common."""
    return fold_name(nfkc(F.coalesce(v, F.lit(""))))


def display_name(v: Column) -> Column:
    """A printed name without invisible characters, letter variants and repeated white space."""
    plain = F.regexp_replace(F.translate(F.coalesce(v, F.lit("")), INVISIBLE, ""), r"(?U)\s+", " ")
    return F.trim(F.translate(plain, READ_FROM, READ_TO))


def canonical_code(v: Column) -> Column:
    """6.10 and 6.1 are one item number; other codes keep their digits and lose their case."""
    c = F.trim(ascii_digits(v))
    whole, part = F.regexp_extract(c, CODE_FROM, 1), F.rtrim(F.regexp_extract(c, CODE_FROM, 2), F.lit("0"))
    number = F.concat(F.coalesce(F.nullif(F.ltrim(whole, F.lit("0")), F.lit("")), F.lit("0")), F.lit("."), F.coalesce(F.nullif(part, F.lit("")), F.lit("0")))
    return F.when(whole != "", number).otherwise(F.lower(c))


def coerce_code(v: Column) -> Column:
    """A code that was read as a number, as text: 21.0 is 21."""
    return F.regexp_replace(v.cast("string"), r"\.0$", "")


def transposed(a: Column, b: Column) -> Column:
    """Whether exchanging one pair of neighbouring characters of a gives b."""
    n = F.length(a)
    swap = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))
    return (n == F.length(b)) & (n > 1) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: swap(i) == b)


def collapsed_zeros(v: Column) -> Column:
    return F.regexp_replace(v, "0+", "0")


def near(a: Column, b: Column) -> Column:
    """One slip apart: a character changed, lost, added or two exchanged, or a run of zeros of another length."""
    apart = F.abs(F.length(a) - F.length(b))
    edited = (apart <= 1) & ((F.levenshtein(a, b, 1) == 1) | (apart == 0) & (F.levenshtein(a, b, 2) == 2) & transposed(a, b))
    return (F.length(a) > 0) & (F.length(b) > 0) & (apart <= 2) & (a != b) & (edited | (collapsed_zeros(a) == collapsed_zeros(b)))


def slip_keys(v: Column) -> Column:
    """Keys of which two values a slip apart have one in common: the value, what is left of it without one character, and its
    form with runs of zeros as one. An exchange of neighbours leaves the same without the one or the other of them."""
    n = F.length(v)
    without = lambda i: F.concat(F.lit("d"), F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1))
    less = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), without)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("d"), v), F.concat(F.lit("z"), collapsed_zeros(v))), less))


def digit_runs(v: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(ascii_digits(v), F.lit(rf"(\d{{{least},}})"), 1)


def signature(v: Column) -> Column:
    """What two reads of a text must agree on: its digit runs in any order; null if it has none."""
    runs = F.array_sort(digit_runs(v))
    return F.when(F.size(runs) > 0, runs)


def usable(v: Column) -> Column:
    """Whether a text layer can serve as a witness: three long digit runs, little junk."""
    junk = F.length(F.regexp_replace(F.coalesce(v, F.lit("")), "[^\ufffd\u0001-\u0008\ue000-\uf8ff]", ""))
    return (F.size(digit_runs(v, 4)) >= 3) & (junk <= 0.05 * F.length(v))


def witness_text(v: Column) -> Column:
    """Lower case, ASCII digits, thousands separators dropped, single spaces; of text in compatibility form."""
    t = F.regexp_replace(F.translate(ascii_digits(v), "٫", "."), MARKS, "")
    t = F.regexp_replace(t, "(?<=\\d)[,٬\u2009\u202f](?=\\d{3}(?!\\d))", "")
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def bounded_in(text: Column, needle: Column) -> Column:
    """Whether needle stands in text with no digit at either side."""
    escaped = F.regexp_replace(needle, r"([\\.\[\]{}()*+?^$|/-])", r"\\$1")
    return (needle != "") & F.regexp_like(text, F.concat(F.lit(r"(?<!\d)"), escaped, F.lit(r"(?!\d)")))


def contains_runs(text: Column, value: Column) -> Column:
    """Whether the digit runs of value follow one another among those of text."""
    have, want = digit_runs(text), digit_runs(value)
    starts = F.sequence(F.lit(1), F.greatest(F.size(have) - F.size(want) + 1, F.lit(1)))
    return (F.size(want) > 0) & F.exists(starts, lambda i: F.slice(have, i, F.greatest(F.size(want), F.lit(1))) == want)


def contains_identifier(text: Column, value: Column) -> Column:
    return bounded_in(witness_text(text), witness_text(value)) | contains_runs(text, value)


def amount_forms(v: Column) -> Column:
    """Printed forms of an amount: two decimals, and without decimals if it is whole, else without trailing zeros."""
    two = F.format_string("%.2f", v)
    short = F.when(v == F.floor(v), F.regexp_replace(two, r"\.00$", "")).otherwise(F.regexp_replace(two, "0+$", ""))
    return F.array_distinct(F.array(two, short))


def doc_key(file_name: Column) -> Column:
    """Kind of an attachment by its file name."""
    name = F.lower(F.coalesce(file_name, F.lit("")))
    out = F.when(F.concat(F.lit(" "), name, F.lit(" ")).rlike("[^a-z0-9]c[.]?r[^a-z0-9]"), "commercial registration")
    for key, (_, hints) in ATTACHMENTS.items():
        out = out.when(F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(name, h)), key)
    return out.otherwise("other")


def clause_period(text: Column) -> Column:
    """day or week if the clause's own words make its rate one of time, else ''."""
    t = ascii_digits(text)
    n = F.coalesce(F.nullif(F.regexp_extract(t, EVERY_DAYS, 1), F.lit("")), F.regexp_extract(t, EVERY_DAYS, 2))
    counted = F.when(n == "1", "day").when(n == "7", "week").otherwise("")
    return F.when(n != "", counted).when(t.rlike(EACH_DAY), "day").when(t.rlike(EACH_WEEK), "week").otherwise("")


def rtl_percent(v: Column) -> Column:
    return F.regexp_replace(v, r"^([0-9.,]+)%$", "%$1")


def decimal_comma(v: Column) -> Column:
    """2.50 as 2,50; a fraction of three digits could be thousands and stays."""
    return F.when(v.rlike(r"^\d+\.(\d{1,2}|\d{4,})$"), F.translate(v, ".", ",")).otherwise(v)


def needles(v: Column) -> Column:
    return F.array_distinct(F.array(v, rtl_percent(v), decimal_comma(v)))


def vat_number_ok(v: Column) -> Column:
    return F.coalesce(v, F.lit("")).rlike("^3[0-9]{13}3$")


def money(v: Column) -> Column:
    return F.format_number(v, 2)


def restyle(original: Column, other: Column) -> Column:
    """other, in the case that original is printed in."""
    return F.when(original == F.upper(original), F.upper(other)).when(original == F.lower(original), F.lower(other)).otherwise(other)


def safe_file_name(v: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(v, F.lit("")), "(?U)[^\\w.\\-\u0600-\u06ff ]", "_"), F.lit("")), F.lit("file"))


def json_object_of(v: Column) -> Column:
    """The outermost braces of a noisy answer, as JSON text, or null."""
    return F.nullif(F.regexp_extract(v, r"(?s)\{.*\}", 0), F.lit(""))


def annotated_pages(text: Column) -> Column:
    """Pages, parted by form feeds, each behind a numbered marker."""
    return F.array_join(F.transform(F.split(text, "\f", -1), lambda x, i: F.concat(F.lit("--- page "), (i + 1).cast("string"), F.lit(" ---\n"), x)), "\n")


# Names of currencies that may stand beside an amount, and what else may be in one.
MONEY_WORDS = r"(?i)(?U)\b(sar|usd|eur|gbp|aed|ريال|درهم|دولار|يورو)\b"
MONEY_SIGNS = r"(?U)[\d\s.,/:%٬٫\-()]+"


def value_digits(v: Column) -> Column:
    """Digits of an amount before its fraction, without leading zeros; empty if more than two other characters stand beside it."""
    rest = F.regexp_replace(F.regexp_replace(v, MONEY_WORDS, ""), MONEY_SIGNS, "")
    plain = F.regexp_replace(ascii_digits(v), r"(?<=\d)[,٬\s](?=\d{3}(?!\d))", "")
    whole = F.split(F.regexp_extract(plain, r"\d[\d,\s٬٫.]*", 0), "[.٫/]")[0]
    return F.when(F.length(rest) > 2, "").otherwise(F.coalesce(F.ltrim(whole, F.lit("0")), F.lit("")))
