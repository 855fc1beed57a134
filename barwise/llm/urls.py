"""URL filters from rules and from mined associations.

Rules name a host and a path: a rule fits its host and all subdomains where the path starts with its own; the longest
wins. Hosts are cut into their suffixes, so rules of any number are matched by an equality join.

For URLs without a rule, Spark's FP-growth mines which combinations of URL tokens go with the label ``block`` among the
labelled ones (in the query: those that a rule judges). Associations are pruned by support and confidence, and each is
filed under its rarest token (an inverted index), so a URL meets only associations that share that token; the rest of
the combination is compared in place. Words that the rules themselves consist of, two-letter path segments (languages) and
host scaffold (``www``, ``m`` and the like) are no tokens, as they would only say the rules again.

An association must also say more than where its pages lie. Judged pages are split by domain and, apart from that, by
language of the path. A part whose pages all have one verdict tells nothing about their words. Over the other parts the
lower confidence bound of the association's share of ``block`` must be above the share expected from its parts, by domain
and by language; what meets no part with both verdicts is dropped.

Cases: a null URL or one without ``://`` has an empty host and path, no rule and no token, and is allowed; repeated rows
get the same result each; an empty table gives an empty result; other columns are ignored.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import functions as F

from barwise.llm.common import ascii_lower, stored

SUPPORT, CONFIDENCE = 0.0005, 0.9
Z = 3.0  # standard errors of the confidence bound
BLOCKED = "=block"
#: Host labels that name a service, not a site.
SCAFFOLD = ("www", "m", "mobile", "blog")
_LANGUAGE = r"(?<=/)[a-z]{2}(?=[/?#]|$)"


def host_and_path(url):
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end."""
    start = F.instr(url, "://")
    after = F.coalesce(F.when(start > 0, F.substr(url, start + 3)), F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def tokens(url, ignored):
    """Distinct lower-case words of a URL without digits: host labels and their parts, path, query and fragment words, but
    no two-letter path segments and no host scaffold."""
    text = ascii_lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:]*://", ""))
    text = F.regexp_replace(text, _LANGUAGE, "")
    words = F.concat(F.split(text, r"[^a-z0-9\u0080-￿]+"), F.split(F.regexp_extract(text, r"^([^/?#]*)", 1), r"\."))
    return F.filter(F.array_distinct(words), lambda w: (w != "") & ~w.rlike("[0-9]") & ~w.isin(*ignored, *SCAFFOLD))


def parts(host, path):
    """The domain (last two labels of the host) and the language (first two-letter segment of the path, or none)."""
    return F.substring_index(host, ".", -2).alias("domain"), F.regexp_extract(ascii_lower(path), _LANGUAGE, 0).alias("language")


def with_rules(pages, rules, id_col="page_id", url_col="url"):
    """row, id, url, host, path, rule and verdict (null without a rule). ``rules``: (verdict, host and path)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = stored(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")
    ))
    table = spark.createDataFrame(
        [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules], "verdict string, rule string, suffix string, start string"
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = rows.select("row", "path", F.explode(suffixes).alias("suffix")).join(table, "suffix").filter(F.col("path").startswith(F.col("start")))
    best = fits.groupBy("row").agg(F.max(F.struct(F.length("rule"), F.col("rule"), F.col("verdict"))).alias("best"))
    return rows.join(best, "row", "left").select("row", "id", "url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def _above_base(found, rows, bases, dimensions, z):
    """``n`` of the combinations whose lower bound of the share of ``block`` is above the one expected from their parts."""
    spread = rows.select("*", F.explode("items").alias("key"))
    pages = spread.join(found.select("n", "wanted", "key"), "key").filter(F.size(F.array_except("wanted", "items")) == 0)
    out = None
    for name in dimensions:
        base = F.col("base")
        seen = pages.join(bases[name], name).groupBy("n").agg(
            F.sum("count").alias("pages"), F.sum("blocked").alias("blocked"), (F.sum(base * F.col("count")) / F.sum("count")).alias("expected")
        )
        size, share = F.col("pages"), F.col("blocked") / F.col("pages")
        bound = (share + z * z / (2 * size) - z * F.sqrt(share * (1 - share) / size + z * z / (4 * size * size))) / (1 + z * z / size)
        told = seen.select("n", (bound > F.col("expected")).alias("above"))
        out = told if out is None else out.unionByName(told)
    return out.groupBy("n").agg(F.bool_and("above").alias("above")).filter("above").select("n")


def associations(labelled, support=SUPPORT, confidence=CONFIDENCE, z=Z):
    """Token combinations that go with ``block``: tokens, confidence, key (the rarest token). ``labelled``: tokens, label
    (boolean: blocked), and domain and language if the pages have them (else they are one part). A combination that holds a
    smaller accepted one adds nothing and is left out."""
    spark, kind = labelled.sparkSession, "tokens array<string>, confidence double, key string"
    dimensions = [c for c in ("domain", "language") if c in labelled.columns]
    if not dimensions:
        labelled, dimensions = labelled.withColumn("domain", F.lit("")), ["domain"]
    # one row per distinct basket and part; the parts' shares count pages without tokens too
    whole = stored(labelled.groupBy(F.array_sort("tokens").alias("items"), *dimensions).agg(
        F.count(F.lit(1)).alias("count"), F.count_if("label").alias("blocked")
    ))
    rows = whole.filter(F.size("items") > 0)
    bases, shares = {}, []
    for name in dimensions:
        share = F.sum("blocked") / F.sum("count")
        bases[name] = stored(whole.groupBy(name).agg(share.alias("base")).filter("base > 0 and base < 1"))
        shares.append(bases[name].agg(F.min("base")).first()[0])
    total = rows.agg(F.sum("count")).first()[0]
    shares = [x for x in shares if x is not None]
    if not total or not shares:
        return spark.createDataFrame([], kind)
    # fewer pages than this cannot lift the bound above the smallest share
    least = z * z * min(shares) / (1 - min(shares))
    counts = stored(rows.select(F.explode("items").alias("token"), "count").groupBy("token").agg(F.sum("count").alias("count")))
    baskets = labelled.filter(F.size("tokens") > 0).select(
        F.when(F.col("label"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items")
    )
    model = FPGrowth(itemsCol="items", minSupport=min(max(support, least / total), 1.0), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.col("consequent")[0] == BLOCKED).select(F.array_sort("antecedent").alias("wanted"), "confidence")
    rules = stored(rules.withColumn("n", F.monotonically_increasing_id()))
    keys = rules.select("n", F.explode("wanted").alias("token")).join(counts, "token").groupBy("n").agg(F.min(F.struct("count", "token"))["token"].alias("key"))
    keyed = stored(rules.join(keys, "n"))
    found = stored(keyed.join(_above_base(keyed, rows, bases, dimensions, z), "n", "left_semi"))
    smaller = found.select(F.col("wanted").alias("part"), F.size("wanted").alias("size"))
    # subsets are looked up by their first token: a part's first token is one of the whole's
    inside = found.select("n", "wanted", F.explode("wanted").alias("first")).join(
        smaller, (F.col("first") == F.col("part")[0])
    ).filter((F.col("size") < F.size("wanted")) & (F.size(F.array_except("part", "wanted")) == 0)).select("n").distinct()
    return found.join(inside, "n", "left_anti").select(F.col("wanted").alias("tokens"), "confidence", "key")


def matched(rows, index):
    """Rows (row, tokens) that hold all tokens of an association: row, confidence."""
    by_key = index.select(F.col("key"), F.col("tokens").alias("wanted"), "confidence")
    spread = rows.select("row", "tokens", F.explode("tokens").alias("key"))
    return spread.join(by_key, "key").filter(F.size(F.array_except("wanted", "tokens")) == 0).groupBy("row").agg(F.max("confidence").alias("confidence"))


def judge(pages, rules, id_col="page_id", url_col="url", **pruning):
    """One row per page: id, url, host, path, rule, verdict, confidence (of a mined association, else null)."""
    ruled = stored(with_rules(pages, rules, id_col, url_col))
    ignored = sorted({w for _, r in rules for w in r.lower().replace("/", ".").split(".") if w})
    split = ruled.withColumn("tokens", F.when(F.col("host") != "", tokens(F.col("url"), ignored)).otherwise(F.array().cast("array<string>")))
    labelled = split.filter("rule is not null").select("tokens", (F.col("verdict") == "block").alias("label"), *parts(F.col("host"), F.col("path")))
    index = stored(associations(labelled, **pruning))
    hits = matched(split.filter("rule is null").select("row", "tokens"), index)
    return ruled.join(hits, "row", "left").select(
        "id", "url", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence",
    )
