"""The posts dump: one XML element per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The attributes of a dump row and the numeric post types.
ATTRIBUTES = (
    "Id", "PostTypeId", "AcceptedAnswerId", "ParentId", "CreationDate", "Score", "ViewCount",
    "Body", "Title", "Tags", "AnswerCount", "CommentCount", "FavoriteCount",
)
QUESTION, ANSWER = 1, 2

_CORRUPT = "_corrupt"
_XML_SCHEMA = ", ".join(f"_{a} STRING" for a in ATTRIBUTES) + f", {_CORRUPT} STRING"
_XML_OPTIONS = {
    "attributePrefix": "_",
    "mode": "PERMISSIVE",
    "ignoreSurroundingSpaces": "false",
    "columnNameOfCorruptRecord": _CORRUPT,
}
# A line is one element: self-closing with no second "<", or closed by its own end tag.
# from_xml alone would also take text or elements behind the first one.
_ONE_ELEMENT = (
    r"^\s*(<[^<]*/>|<([^\s/>]+)(?:\s[^<]*[^/<])?>"
    r"(?![\s\S]*</\2[\s>][\s\S]*</\2[\s>])[\s\S]*</\2\s*>)\s*$"
)
# A known attribute written with other upper and lower case letters; what stands in quotes is
# matched first, as a whole, and kept.
_NAMES = "|".join(ATTRIBUTES)
_OTHER_CASE = (
    rf"""("[^"]*"|'[^']*')|\s(?!(?:{_NAMES})\s*=)(?i:{_NAMES})\s*=\s*(?:"[^"]*"|'[^']*')"""
)
_WHOLE_NUMBER = r"^[+-]?[0-9]+$"
_LOCAL_DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{0,9})?)?$"


def _number(attribute: Column, as_type: str) -> Column:
    return F.when(attribute.rlike(_WHOLE_NUMBER), attribute).try_cast(as_type)


def parse_posts(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(value, valid, post)`` for every line, where ``post`` has the thirteen post fields.

    A line is invalid when it is not one well-formed element, when id, type, date or score
    are missing or malformed, or when a field that its post type reads is present but
    malformed. Fields of the other post types are null, whatever the line says. Attribute names
    are compared to the letter, whatever the session does with column names: an attribute in
    other case is unknown and does not count.
    """
    exact = F.regexp_replace(F.col(value), _OTHER_CASE, "$1")
    # The one-element arrays are there for their generators: filters and projections are not
    # moved below a generator, so each line is parsed, and each field converted, just once.
    parsed = lines.select(
        F.col(value).alias("value"),
        F.explode(F.array(F.from_xml(exact, _XML_SCHEMA, _XML_OPTIONS))).alias("x"),
    )
    x = {a: F.col(f"x._{a}") for a in ATTRIBUTES}
    kind = _number(x["PostTypeId"], "int")

    def optional(name: str, of_type: int) -> Column:
        return F.when(kind == of_type, F.nullif(x[name], F.lit("")))

    raw = {
        "acceptedAnswerId": optional("AcceptedAnswerId", QUESTION),
        "parentId": optional("ParentId", ANSWER),
        "viewCount": optional("ViewCount", QUESTION),
        "answerCount": optional("AnswerCount", QUESTION),
        "commentCount": optional("CommentCount", QUESTION),
        "favoriteCount": optional("FavoriteCount", QUESTION),
    }
    text = {
        "title": F.when(kind == QUESTION, F.coalesce(x["Title"], F.lit(""))),
        "tags": F.when(kind == QUESTION, F.coalesce(x["Tags"], F.lit(""))),
    }
    created = F.when(x["CreationDate"].rlike(_LOCAL_DATE_TIME), x["CreationDate"])
    fields = {
        "id": _number(x["Id"], "bigint"),
        "postTypeId": kind,
        # both post references are 32-bit in the archive; larger ones make the line invalid
        "acceptedAnswerId": _number(raw["acceptedAnswerId"], "int").cast("bigint"),
        "parentId": _number(raw["parentId"], "int").cast("bigint"),
        "creationDate": created.try_cast("timestamp"),
        "score": _number(x["Score"], "int"),
        "viewCount": _number(raw["viewCount"], "int"),
        "body": F.coalesce(x["Body"], F.lit("")),
        "title": text["title"],
        "tags": text["tags"],
        "answerCount": _number(raw["answerCount"], "int"),
        "commentCount": _number(raw["commentCount"], "int"),
        "favoriteCount": _number(raw["favoriteCount"], "int"),
    }
    well_formed = F.col(f"x.{_CORRUPT}").isNull() & F.col("value").rlike(_ONE_ELEMENT)
    converted = parsed.select(
        "value",
        F.inline(
            F.array(
                F.struct(
                    well_formed.alias("well_formed"),
                    F.struct(*[c.alias(n) for n, c in raw.items()]).alias("raw"),
                    F.struct(*[c.alias(n) for n, c in fields.items()]).alias("post"),
                )
            )
        ),
    )
    valid = F.col("well_formed")
    for name in ("id", "postTypeId", "creationDate", "score"):
        valid = valid & F.col(f"post.{name}").isNotNull()
    for name in raw:
        valid = valid & (F.col(f"raw.{name}").isNull() | F.col(f"post.{name}").isNotNull())
    return converted.select("value", F.coalesce(valid, F.lit(False)).alias("valid"), "post")


def posts_from_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The valid posts of a dump, one column per field."""
    return parse_posts(lines, value).filter("valid").select("post.*")


def rejected_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """The lines that :func:`posts_from_lines` leaves out."""
    return parse_posts(lines, value).filter(~F.col("valid")).select("value")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of the dump at ``path``; plain and bzip2 files are split over many tasks."""
    return posts_from_lines(spark.read.text(path))


def stage_posts(posts: DataFrame, path: str) -> DataFrame:
    """Write the parsed posts once as parquet, by year, and read them from there.

    Every corpus then scans only the columns, folders and row groups it needs instead of the
    XML. ``creationYear`` is a column more: it names the folder, and ``since_year`` uses it.
    """
    # Rebalanced, or every task would write a file for each year.
    by_year = posts.withColumn("creationYear", F.year("creationDate"))
    by_year.hint("rebalance", "creationYear").write.mode("overwrite").partitionBy("creationYear").parquet(path)
    return posts.sparkSession.read.parquet(path)
