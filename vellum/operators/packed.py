"""Several values packed in one field: one row a value, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks that separate wherever they stand outside quotes; a comma separates only in fields that hold none of them.
STRONG = r"[;|\t\n\r、，；]"
ANY = r"[,;|\t\n\r、，；]"
SPACE = r"[\s\u00a0\u3000\ufeff]"
#: A quoted element: from the start of an element to its end. A quotation mark inside words (O'Neil, "x" y) quotes nothing.
#: The body is unrolled so that long quotes need no recursion in the regular-expression engine.
QUOTED = (
    rf"(?:^|(?<={ANY})){SPACE}*+"
    rf'(?:"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"|\'[^\'\\]*+(?:(?:\\.|\'(?!{SPACE}*+(?:{ANY}|$)))[^\'\\]*+)*+\')'
    rf"{SPACE}*+(?={ANY}|$)"
)
MARK, LITERAL = "\u0001", "\u0001x"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def unquoted(c: Column) -> Column:
    """The value of a quoted element: without its marks, \\x read as x, doubled double quotes as one."""
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    return F.regexp_replace(F.when(c.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(inner), r"(?s)\\(.)", "$1")


def unpack(df: DataFrame, keys: list[str], fields: list[str], authors: tuple[str, ...] = ("authors",)) -> DataFrame:
    """(keys, field_name, pos, value): one row a value, pos from 1 counting only values that exist.

    Outer [ ] or { } are dropped. Quoted spans are replaced by placeholders that hold their index between two U+0001; a
    U+0001 of the text itself becomes U+0001 x first, so a placeholder can't collide. What remains is split at ; | tab, line
    breaks and full-width marks if it has any, else at commas, and the spans are restored by array lookup. Elements are
    trimmed, empty ones dropped. In a field of `authors` without outer brackets that is separated by commas (or by nothing),
    an unquoted last element is split at a leading or inner "and" or "&". Null, blank and empty fields give no row, a quote
    that isn't closed quotes nothing. One pass over the input, no shuffle; each step is a projection of its own, so that none
    is computed twice; other columns of df, whatever their names, aren't read.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("__raw")) for f in fields]))
    rows = df.select(*keys, each.alias("__e")).select(*keys, "__e.field_name", strip(F.replace("__e.__raw", F.lit(MARK), F.lit(LITERAL))).alias("__text")).filter("__text <> ''")
    rows = rows.withColumn("__boxed", F.col("__text").rlike(r"(?s)^(?:\[.*\]|\{.*\})$"))
    rows = rows.withColumn("__text", F.when(F.col("__boxed"), F.expr("substring(__text, 2, length(__text) - 2)")).otherwise(F.col("__text")))
    quoting = F.col("__text").contains('"') | F.col("__text").contains("'")
    rows = rows.withColumn("__quotes", F.when(quoting, F.regexp_extract_all("__text", F.lit(f"({QUOTED})"), F.lit(1))))
    rows = rows.withColumn("__pieces", F.when(F.size("__quotes") > 0, F.split("__text", QUOTED, -1)))
    marked = F.transform("__pieces", lambda p, i: F.when(i < F.size("__quotes"), F.concat(p, F.lit(MARK), i.cast("string"), F.lit(MARK))).otherwise(p))
    rows = rows.withColumn("__held", F.when(F.col("__pieces").isNull(), F.col("__text")).otherwise(F.concat_ws("", marked)))
    rows = rows.withColumn("__strong", F.col("__held").rlike(STRONG))
    rows = rows.withColumn("__bare", F.when(F.col("__strong"), F.split("__held", STRONG, -1)).otherwise(F.split("__held", ",", -1)))
    rows = rows.withColumn("__bare", F.filter(F.transform("__bare", strip), lambda e: e != ""))
    rows = rows.withColumn("__last", F.when(F.col("field_name").isin(*authors) & ~F.col("__boxed") & ~F.col("__strong") & (F.size("__bare") > 0), F.element_at("__bare", -1)))
    joint = F.split("__last", rf"(?:^|,?{SPACE}+)(?:and|AND|And|&){SPACE}+(?=\S)", -1)
    rows = rows.withColumn("__parts", F.when(F.col("__last").rlike(r"(?:^|\s)(?:and|AND|And|&)\s") & ~F.col("__last").contains(MARK), F.filter(F.transform(joint, strip), lambda e: e != "")))
    rows = rows.withColumn("__bare", F.when(F.col("__parts").isNull(), F.col("__bare")).otherwise(F.concat(F.expr("slice(__bare, 1, size(__bare) - 1)"), "__parts")))
    index = lambda e: F.nullif(F.regexp_extract(e, "^\u0001([0-9]+)\u0001$", 1), F.lit("")).cast("int")
    rows = rows.withColumn("__found", F.transform("__bare", lambda e: F.when(e.startswith(MARK), strip(F.get("__quotes", index(e))))))
    rows = rows.withColumn("__found", F.when(F.col("__pieces").isNull(), F.col("__bare")).otherwise(F.zip_with("__bare", "__found", lambda e, q: F.coalesce(unquoted(q), e))))
    plain = F.transform("__found", lambda v: strip(F.replace(v, F.lit(LITERAL), F.lit(MARK))))
    return rows.select(*keys, "field_name", F.posexplode(F.filter(plain, lambda v: v != "")).alias("pos", "value")).withColumn("pos", F.col("pos") + 1)
