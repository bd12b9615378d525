"""Data-preparation jobs (PREP1-PREP4) as column expressions over whole
texts, plus the seeded synthetic generators used in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import java_hash_code

# --------------------------------------------------------------------------
# PREP1: review blocks → "hash(product)::hash(user)::score::time"
# --------------------------------------------------------------------------

REVIEW_FIELDS = 8


def convert_reviews(blocks: DataFrame, col: str = "value") -> DataFrame:
    """Each row is one blank-line separated block of ``key: value`` lines
    (``spark.read.option('lineSep', '\\n\\n').text``).  Lines without a
    ``:`` are skipped; a block must then hold exactly 8 fields; output is
    ``hashCode(field0)::hashCode(field1)::field4::field5``.  One compiled
    expression reads a block; a lambda over its lines would be interpreted."""
    # of every line with a colon, what follows the first one, without white space before and blanks after it
    vals = F.regexp_extract_all(F.col(col), F.lit(r"(?dm)^[^\n:]*:[^\S\n]*([^\n]*?) *$"), 1)
    b = blocks.select(vals.alias("f")).filter(F.size("f") == REVIEW_FIELDS)
    return b.select(F.concat_ws("::", java_hash_code(F.col("f")[0]).cast("string"),
                                java_hash_code(F.col("f")[1]).cast("string"),
                                F.col("f")[4], F.col("f")[5]).alias("line"))


# --------------------------------------------------------------------------
# PREP2: page corpus
# --------------------------------------------------------------------------

def page_parts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, body text (article with tags stripped, CR/LF → space, runs of
    spaces collapsed) and category string ``:a:b`` (navigation targets)."""
    h = F.col(html)
    title = F.translate(F.regexp_extract(h, r"<title>([^<]*)</title>", 1), "\r\n", "  ")
    body = F.regexp_extract(h, r"(?s)<article>(.*)</article>", 1)
    text = F.trim(F.regexp_replace(F.translate(F.regexp_replace(body, r"<[^>]*>", " "), "\r\n", "  "),
                                   " +", " "))
    cats = F.regexp_extract_all(h, F.lit(r'<li><a href="/([^"]*)">'), 1)
    category = F.concat_ws("", F.transform(cats, lambda c: F.concat(F.lit(":"), c)))
    return pages.select("*", title.alias("title"), text.alias("text"), category.alias("category"))


def page_corpus(pages: DataFrame, min_chars: int = 100) -> DataFrame:
    """PREP2: ``category :::: title text`` for pages whose text has at least
    ``min_chars`` characters."""
    p = page_parts(pages)
    return (p.filter(F.length("text") >= min_chars)
            .select("page_id", F.concat(F.col("category"), F.lit(" :::: "), F.col("title"),
                                        F.lit(" "), F.col("text")).alias("line")))


def page_counters(pages: DataFrame, min_chars: int = 100) -> DataFrame:
    """PREP2 counters: pages seen, pages kept, pages with a category."""
    p = page_parts(pages)
    big = F.length("text") >= min_chars
    return p.agg(F.count(F.lit(1)).alias("pages"), F.count_if(big).alias("big_pages"),
                 F.count_if(big & (F.length("category") > 0)).alias("with_category"))


# --------------------------------------------------------------------------
# PREP3 / PREP4: seeded synthetic generators (tests and benchmarks only)
# --------------------------------------------------------------------------

def labeled_points(spark: SparkSession, rows: int, dim: int, kind: str = "logistic",
                   seed: int = 42, noise: float = 0.1, parts: int | None = None,
                   weight_seed: int = 1) -> DataFrame:
    """PREP3: ``label double, features array<double>``; x uniform in [-1, 1];
    the label is the sign (svm/logistic) or the value (linear) of a fixed
    random weight vector applied to x, plus Gaussian noise."""
    r = spark.range(0, rows, numPartitions=parts) if parts else spark.range(0, rows)
    xs = [F.rand(seed + j) * 2 - 1 for j in range(dim)]
    import random
    rng = random.Random(weight_seed)
    w = [rng.gauss(0, 1) for _ in range(dim)]
    df = r.select(F.array(*xs).alias("features"))
    y = F.aggregate(F.zip_with("features", F.array(*[F.lit(v) for v in w]), lambda a, b: a * b),
                    F.lit(0.0), lambda acc, v: acc + v) + F.lit(noise) * F.randn(seed + dim)
    if kind == "linear":
        lab = y
    else:
        lab = F.when(y > 0, 1.0).otherwise(0.0)
    return df.select(lab.alias("label"), "features")


# The page-view distribution of the streaming example
# generator (value, probability).
PAGES = [("http://foo.com/", 0.7), ("http://foo.com/news", 0.2), ("http://foo.com/contact", 0.1)]
HTTP_STATUSES = [(200, 0.95), (404, 0.05)]
ZIP_CODES = [(94709, 0.5), (94117, 0.5)]
USERS = 100


def _draw(u, table):
    """Categorical draw from ``[(value, p)]`` with a uniform column ``u``."""
    expr, acc = None, 0.0
    for value, prob in table[:-1]:
        acc += prob
        expr = F.when(u < acc, F.lit(value)) if expr is None else expr.when(u < acc, F.lit(value))
    last = F.lit(table[-1][0])
    return last if expr is None else expr.otherwise(last)


def page_views(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """PREP4: weighted draws of page, status and zip code, users 1..100."""
    r = spark.range(0, rows)
    user = (F.floor(F.rand(seed + 3) * USERS) + 1).cast("int")
    return r.select(_draw(F.rand(seed), PAGES).alias("url"),
                    _draw(F.rand(seed + 1), HTTP_STATUSES).alias("status"),
                    _draw(F.rand(seed + 2), ZIP_CODES).alias("zip"), user.alias("user"))
