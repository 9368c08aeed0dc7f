"""Text functions as column expressions.

Offsets count code points. White space is Unicode white space unless said otherwise.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are dropped before offsets are taken.
INVISIBLE = "[\\x{FEFF}\\x{200B}-\\x{200D}\\x{2060}]"
#: Families of SQL column types.
INTEGER_TYPES = ["int", "integer", "smallint", "bigint", "mediumint", "tinyint", "int2", "int4", "int8", "serial", "bigserial", "smallserial", "serial2", "serial4", "serial8", "year", "bit"]
FLOAT_TYPES = ["numeric", "decimal", "dec", "real", "double", "float", "float4", "float8", "money"]
#: Scalar property types of published models.
PROPERTY_TYPES = ["String", "Integer", "Float", "Boolean", "Date", "Timestamp"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def normalize_whitespace(c) -> Column:
    """unified line ends, no invisible characters, single spaces in trimmed lines, one blank line at most."""
    s = F.regexp_replace(col(c), "\\r\\n?", "\n")
    s = F.regexp_replace(F.regexp_replace(s, INVISIBLE, ""), "\\x{00A0}", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\S\n]+", " "), "(?md)^ +| +$", "")
    return strip(F.regexp_replace(s, "\n{3,}", "\n\n"))


def normalize_search(c) -> Column:
    """the form in which quotations are compared."""
    return F.lower(strip(F.regexp_replace(col(c), r"(?U)\s+", " ")))


search_form = normalize_search


def slugify(c) -> Column:
    """F3 for text without combining marks: lower case, other characters to single hyphens, ``x`` for nothing."""
    s = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9.-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), r"\.{2,}", ".")
    s = F.regexp_replace(s, r"^[-.]+|[-.]+$", "")
    return F.when(s == "", "x").otherwise(s)


def fold_marks(keep: bool = False):
    """F3's decomposition (NFKD, without marks unless ``keep``), which Spark has no function for, as an Arrow UDF."""
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join(ch for ch in unicodedata.normalize("NFKD", x.lower()) if keep or not "\u0300" <= ch <= "\u036f"))

    return fold


def local_slug(c) -> Column:
    """as F3, but characters are not decomposed and runs of dots stay."""
    s = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9.-]+", "-")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(s == "", "x").otherwise(s)


def file_slug(c) -> Column:
    """of a file's name without its extension, at most 64 characters. Marks that decomposition sets free become hyphens."""
    s = fold_marks(keep=True)(F.regexp_replace(col(c), r"(?i)\.[a-z0-9]+$", ""))
    return F.left(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(64))


def model_type(c) -> Column:
    """published type of a word a model gave; the words are fixed values."""
    raw = strip(F.coalesce(col(c), F.lit("")))
    low = F.lower(raw)
    return (
        F.when(raw.isin(*PROPERTY_TYPES, "List<String>"), raw)
        .when(low.rlike("^list<.+>$") | low.isin("enum", "array"), "List<String>")
        .when(low.isin("integer", "int"), "Integer")
        .when(low.isin("decimal", "money", "float", "number", "double"), "Float")
        .when(low.isin("boolean", "bool"), "Boolean")
        .when(low == "date", "Date")
        .when(low.isin("datetime", "timestamp"), "Timestamp")
        .otherwise("String")
    )


def tool_name(c) -> Column:
    """F32: snake case of a tool's name."""
    s = F.regexp_replace(strip(col(c)), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(s, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def table_cell(c) -> Column:
    """F32: a text as one cell of a Markdown table."""
    return strip(F.regexp_replace(F.regexp_replace(col(c), "\r?\n", " "), r"\|", r"\\|"))


def spread_hash(c) -> Column:
    """32-bit hash of a text's characters, made positive: times 33, exclusive or."""
    codes = F.filter(F.split(col(c), ""), lambda ch: ch != "")
    wrapped = lambda x: F.shiftright(F.shiftleft(x, 32), 32)
    h = F.aggregate(codes, F.lit(5381).cast("bigint"), lambda acc, ch: wrapped((acc * 33).bitwiseXOR(F.ascii(ch).cast("bigint"))))
    return F.abs(h)


def property_type(c) -> Column:
    """published property type of a raw SQL type."""
    raw = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    base = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\(.*$", ""), r"\[\]$", ""), r"\s+", " "))
    first = F.split(base, " ")[0]
    return (
        F.when(raw.endswith("[]") | raw.startswith("enum") | raw.startswith("set(") | (raw == "set"), "List<String>")
        .when(raw.isin("tinyint(1)", "bool", "boolean"), "Boolean")
        .when(F.contains(base, F.lit("varying")) | base.startswith("char") | base.startswith("national char"), "String")
        .when(base.startswith("double"), "Float")
        .when(base.startswith("timestamp") | base.startswith("datetime"), "Timestamp")
        .when(first.isin(INTEGER_TYPES), "Integer")
        .when(first.isin(FLOAT_TYPES), "Float")
        .when(first.isin("bool", "boolean"), "Boolean")
        .when(first == "date", "Date")
        .otherwise("String")
    )


def is_list_type(c) -> Column:
    """a scalar type in any number of balanced ``List<...>``."""
    t = col(c)
    closed = F.length(F.regexp_extract(t, ">*$", 0))
    opened = (F.length(F.regexp_extract(t, "^(List<)*", 0)) / 5).cast("int")
    return t.rlike("^(List<)*(" + "|".join(PROPERTY_TYPES) + ")>*$") & (opened == closed)


def spaced(c) -> Column:
    """Words of an identifier or phrase, one space between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(c), "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " "))


def words(c) -> Column:
    """words of an identifier or phrase: camel humps and other separators apart."""
    return F.filter(F.split(spaced(c), " "), lambda w: w != "")


def tail(w: Column) -> Column:
    """All but the first character."""
    return F.right(w, F.greatest(F.length(w) - 1, F.lit(0)))


def snake(c) -> Column:
    return F.lower(F.array_join(words(c), "_"))


def pascal_snake(c) -> Column:
    return F.array_join(F.transform(words(c), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(tail(w)))), "_")


def camel(c) -> Column:
    return F.array_join(F.transform(words(c), lambda w, i: F.when(i == 0, F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(tail(w))))), "")


def upper_snake(c) -> Column:
    return F.upper(F.translate(spaced(c), " ", "_"))


def first_clause(c) -> Column:
    """up to the first of ``.;:,``."""
    return strip(F.split(col(c), "[.;:,]")[0])


def title_seed(c) -> Column:
    """up to the first sentence end, colon or line break, shortened to 57 characters beyond 60; else the text's beginning, else ``Rule``."""
    t = F.coalesce(col(c), F.lit(""))
    s = strip(F.split(t, "[.!?;:\n]")[0])
    clipped = F.when(F.length(s) > 60, F.concat(F.left(s, F.lit(57)), F.lit("..."))).otherwise(s)
    return F.coalesce(F.nullif(clipped, F.lit("")), F.nullif(F.left(t, F.lit(57)), F.lit("")), F.lit("Rule"))


def clamp01(c) -> Column:
    """into [0, 1]; 0 for nulls and what is not finite."""
    x = F.nanvl(F.coalesce(col(c), F.lit(0.0)), F.lit(0.0))
    return F.when(F.abs(x) == float("inf"), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def quoted_list(c) -> Column:
    """contents of the single-quoted strings in a list."""
    return F.transform(F.regexp_extract_all(col(c), F.lit("'((?:[^']|'')*)'"), F.lit(1)), lambda x: F.replace(x, F.lit("''"), F.lit("'")))


def has_word(text, word) -> Column:
    """``word`` stands in ``text`` as an identifier of its own."""
    padded = F.concat(F.lit(" "), F.regexp_replace(col(text), "[^A-Za-z0-9_]", " "), F.lit(" "))
    return F.contains(padded, F.concat(F.lit(" "), col(word), F.lit(" ")))


def json_slice(c) -> Column:
    """the outermost object or array in a text around it; null where there is none or it does not parse."""
    s = F.regexp_replace(col(c), "(?s)```(?:json)?", "")
    found = F.regexp_extract(s, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def line_number(text, offset) -> Column:
    """1-based line of a 0-based offset."""
    head = F.left(col(text), col(offset))
    return 1 + F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def search_tokens(c) -> Column:
    """lower-case runs of a-z, 0-9 and East Asian characters, of two characters or more; repeats stay."""
    return F.filter(F.split(F.lower(col(c)), r"[^a-z0-9\x{4E00}-\x{9FFF}]+"), lambda w: F.length(w) >= 2)


def detect_format(name, mime) -> Column:
    """Kind of a document by media type, then extension."""
    m, ext = F.lower(F.coalesce(col(mime), F.lit(""))), F.lower(F.regexp_extract(F.trim(col(name)), r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(F.contains(m, F.lit("pdf")) | (ext == "pdf"), "pdf")
        .when(F.contains(m, F.lit("officedocument.wordprocessingml")) | F.contains(m, F.lit("msword")) | ext.isin("docx", "doc"), "docx")
        .when(F.contains(m, F.lit("html")) | ext.isin("html", "htm"), "html")
        .otherwise("text")
    )


def strip_tags(c) -> Column:
    """S3: markup to text: no script or style, block ends to line breaks, common references decoded."""
    s = F.regexp_replace(col(c), r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " ")
    s = F.regexp_replace(s, r"(?i)</(p|div|li|tr|h[1-6]|section|article|header|footer|table|ul|ol)>|<br\s*/?>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, "(?s)<!--.*?-->", " "), "<[^>]+>", " ")
    #: The named references that are decoded, in this order.
    for ref, ch in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        s = F.regexp_replace(s, f"(?i){ref}", ch)
    # Decimal references, ASCII printable ones; each is one code, so all of one code are replaced at once.
    codes = F.array_distinct(F.regexp_extract_all(s, F.lit("&#([0-9]{1,7});"), F.lit(1)))
    return F.when(F.contains(s, F.lit("&#")), F.aggregate(codes, s, lambda acc, d: F.replace(acc, F.concat(F.lit("&#"), d, F.lit(";")), F.chr(d.cast("long"))))).otherwise(s)


def content_ref(c) -> Column:
    """Reference of a parsed text by its content."""
    return F.concat(F.lit("parsed_"), F.substring(F.sha2(col(c), 256), 1, 16))
