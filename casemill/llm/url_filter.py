"""URL filter: host and path rules, and gradient-boosted trees for what no rule decides.

The trees look at lexical features only: lengths, depth, digit and letter shares, entropy of the
characters, counts of labels, parameters and marks, and how often urls with the same host suffix are
blocked among the labelled ones. All features are native expressions; training is Spark's own.

Suffix statistics come from all labelled urls; a labelled url does not see its own label in them. The
trees are fitted on at most ``train_rows`` labelled urls in hash order, the documented bound.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is
judged by the trees like any other; without labels everything else is allowed, with one label that label
decides; ids may be null or repeated, each row is judged by itself; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from casemill.functions.joins import small
from casemill.session import durable

TRAIN_ROWS = 16_384
#: Labelled urls that a suffix counts as having seen before its first, at the overall share.
SUFFIX_PRIOR = 10.0


@dataclass(frozen=True)
class UrlRule:
    """``host/path``: fits the host and its subdomains if the path starts with the rule's path."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own_host, slash, own_path = self.text.partition("/")
        same = (host == own_host) | host.endswith(f".{own_host}")
        return same & path.startswith(slash + own_path)


RULES = (
    UrlRule("net/", "block"),
    UrlRule("example.net/en/", "allow"),
    UrlRule("example.com/de/", "block"),
    UrlRule("org/fr/", "allow"),
)


def parsed(urls: DataFrame, url: str) -> DataFrame:
    """Add ``u`` (the url, null as empty), ``host`` and ``path``."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    start = F.instr(text, "://")
    rest = F.when(start > 0, F.substring(text, start + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return urls.select(
        "*",
        text.alias("u"),
        F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def with_rule(rows: DataFrame, rules: Sequence[UrlRule] = RULES) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` of the longest fitting rule, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def _entropy(text: Column) -> Column:
    """Bits per character: the sorted characters are cut where they change, so any alphabet will do."""
    return F.transform(
        F.array(F.sort_array(F.split(text, ""))),
        lambda s: F.transform(
            F.array(F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))),
            lambda cuts: F.aggregate(
                F.sequence(F.lit(1), F.greatest(F.size(cuts) - 1, F.lit(1))),
                F.lit(0.0),
                lambda total, i: total + _bits(F.get(cuts, i) - F.get(cuts, i - 1), F.size(s)),
            ),
        )[0],
    )[0]


def _bits(n: Column, total: Column) -> Column:
    share = n / total
    return F.coalesce(-share * F.log2(share), F.lit(0.0))


def featured(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Add the lexical features of ``u``, ``host`` and ``path``, and the two host suffixes."""
    u, host, path = F.col("u"), F.col("host"), F.col("path")
    count = lambda pattern, text=u: F.regexp_count(text, F.lit(pattern)).cast("double")
    length = F.greatest(F.length(u), F.lit(1)).cast("double")
    features = {
        "f_length": F.length(u).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": count("/[^/]+", path),
        "f_open_path": path.endswith("/").cast("double"),
        "f_labels": count("[^.]+", host),
        "f_digits": count("[0-9]") / length,
        "f_letters": count("[A-Za-z]") / length,
        "f_upper": count("[A-Z]"),
        "f_hyphens": count("[-_]"),
        "f_parameters": count("[?&][^=&#]+="),
        "f_query": count(r"\?"),
        "f_fragment": count("#"),
        "f_escapes": count("%[0-9A-Fa-f]{2}"),
        "f_secure": u.startswith("https:").cast("double"),
        "f_first_label": F.length(F.substring_index(host, ".", 1)).cast("double"),
        "f_path_head": F.length(F.regexp_extract(path, "^/([^/]*)", 1)).cast("double"),
        "f_entropy": F.when(F.length(u) > 0, _entropy(u)).otherwise(0.0),
    }
    suffixes = {f"s_{n}": F.substring_index(host, ".", -n) for n in (1, 2)}
    columns = {**features, **suffixes}
    return rows.select("*", *[c.alias(n) for n, c in columns.items()]), list(features)


def judged(
    urls: DataFrame, page_id: str = "page_id", url: str = "url", rules: Sequence[UrlRule] = RULES, train_rows: int = TRAIN_ROWS,
    trees: int = 20, depth: int = 4,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, by_trees); urls with a rule are the labelled ones."""
    rows = parsed(urls.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")), "_url").drop("_url")
    rows, names = featured(with_rule(rows, rules))
    rows = durable(rows.withColumn("label", F.when(F.col("rule_verdict").isNotNull(), (F.col("rule_verdict") == "block").cast("double"))))
    labels = {r["label"]: r["count"] for r in rows.where(F.col("label").isNotNull()).groupBy("label").count().collect()}
    if len(labels) < 2:
        fixed = F.lit("block" if 1.0 in labels else "allow")
        return rows.select(
            "page_id", "host", "path", "rule", F.coalesce("rule_verdict", fixed).alias("verdict"), fixed.alias("by_trees")
        )
    overall = labels[1.0] / sum(labels.values())
    for n in (1, 2):
        stats = rows.where(F.col("label").isNotNull()).groupBy(F.col(f"s_{n}").alias("_s")).agg(
            F.sum("label").alias("_blocked"), F.count("label").alias("_seen")
        )
        own = F.coalesce(F.col("label"), F.lit(0.0))
        seen = F.coalesce(F.col("_seen"), F.lit(0)) - F.col("label").isNotNull().cast("int")
        blocked = F.coalesce(F.col("_blocked"), F.lit(0.0)) - own
        rows = rows.join(small(durable(stats)), F.col(f"s_{n}") == F.col("_s"), "left").withColumn(
            f"f_suffix_{n}", (blocked + SUFFIX_PRIOR * overall) / (seen + SUFFIX_PRIOR)
        ).withColumn(f"f_suffix_{n}_seen", F.log1p(seen.cast("double"))).drop("_s", "_blocked", "_seen")
        names += [f"f_suffix_{n}", f"f_suffix_{n}_seen"]
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    ready = durable(ready.select("page_id", "host", "path", "rule", "rule_verdict", "label", "u", "features"))
    train = durable(
        ready.where(F.col("label").isNotNull()).orderBy(F.xxhash64("u"), "u").limit(train_rows).select("features", "label")
    )
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7).fit(train)
    verdict = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return model.transform(ready).select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", verdict).alias("verdict"),
        verdict.alias("by_trees"),
    )
