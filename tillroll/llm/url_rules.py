"""URL filters: curated host and path rules, then mined association rules.

A curated rule fits its host and all subdomains if the url's path starts with the rule's
path; the longest (host and path together) wins.  Urls without a curated rule are judged
by association rules.  Tokens that stand on the same labelled urls say the same, so they
become one item (a deep folder of one site is one item, not a thousand combinations);
FP-growth mines frequent combinations of items with the verdicts, rules below a support
or confidence are dropped, as are rules that a shorter one implies with no less
confidence (all others are kept, of any length), and an inverted index (token -> rules)
finds the rules of whose items a url has a token each.  The rule of highest confidence
decides (ties: larger support, then block); a url without one is allowed.  The number of
combinations still grows with two to the power of the items that share enough urls with
one another but not all, as of folders in folders.

Tokens are the labels of the host (by name), the segments of the path without digits,
the words of both, and the names of query parameters.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and
is allowed; repeated urls get equal verdicts; without labels there are no mined rules; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

# Fixed values: (verdict, host, path) of the curated rules.
CURATED = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
           ("block", "net", "/es/"), ("block", "net", "/fr/"))
BLOCK, ALLOW = "verdict=block", "verdict=allow"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.7
# Rules up to this number are broadcast (about 200 bytes each); more are shuffle-joined.
BROADCAST_RULES = 20_000
# Judged urls and items of tokens up to this number are broadcast (about 150 bytes each); more are shuffle-joined.
BROADCAST_ROWS = 100_000
# Tokens of fewer labelled urls than this cannot be in a rule that is worth keeping.
MIN_URLS = 20


def host_of(url: Column) -> Column:
    """A-Z lower-cased host; empty for null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def curated_rule(host: Column, path: Column, rules=CURATED) -> Column:
    """The rule that fits best as (verdict, rule), or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(out)
    return out


def tokens(host: str, path: str, url: str) -> Column:
    """Distinct tokens of a url."""
    return F.expr(
        f"array_distinct(concat("
        f"transform(filter(split({host}, '[.:]'), x -> x <> ''), x -> concat('host:', x)),"
        f"transform(filter(split(regexp_replace({path}, '[0-9]+', ''), '/'), x -> x <> ''), x -> concat('path:', lower(x))),"
        f"transform(filter(split(concat({host}, ' ', {path}), '[^a-zA-Z]+'), x -> length(x) > 2), x -> concat('word:', lower(x))),"
        f"transform(regexp_extract_all(coalesce({url}, ''), '[?&]([^=&#]+)=', 1), x -> concat('param:', lower(x)))))")


RULE_COLUMNS = ("items array<string>, verdict string, confidence double, support double, "
                "members array<array<string>>, rule_id long")


def token_items(rows: DataFrame, n: int) -> DataFrame:
    """(item, members): tokens of ``rows`` (row, tokens) that stand on the same rows, named by the first of them.

    Tokens on fewer than MIN_URLS rows cannot support a rule and those on all ``n`` rows
    tell none apart; both are left out.  Row sets are told by their size and two sums of
    hashes.
    """
    marks = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(row))").alias("x"),
        F.expr("sum(cast(xxhash64(row, 1) as decimal(38,0)))").alias("s"))
    kept = marks.where((F.col("n") >= MIN_URLS) & (F.col("n") < n))
    # all members stand on one row, so there are no more of them than tokens of a url
    return kept.groupBy("n", "x", "s").agg(F.sort_array(F.collect_list("token")).alias("members")).select(
        F.col("members")[0].alias("item"), "members")


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, items, members, verdict, confidence, support) mined from (url, blocked) rows.

    ``items`` name the items of the antecedent, ``members`` hold the tokens of each.
    """
    spark = labelled.sparkSession
    ensure_checkpoint_dir(spark)
    rows = (labelled.where("url is not null and blocked is not null")
            .select("blocked", tokens("host", "path", "url").alias("tokens"))
            .withColumn("row", F.monotonically_increasing_id()).checkpoint())
    n = rows.count()
    none = spark.createDataFrame([], RULE_COLUMNS)
    if n == 0:
        return none
    items = token_items(rows, n).checkpoint()
    of_token = items.select("item", F.explode("members").alias("token"))
    of_token = F.broadcast(of_token) if of_token.count() <= BROADCAST_ROWS else of_token
    held = (rows.select("row", F.explode("tokens").alias("token")).join(of_token, "token")
            .groupBy("row").agg(F.collect_set("item").alias("items")))          # items of one url
    verdict = F.when(F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    baskets = rows.join(held, "row", "left").select(
        F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(verdict)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, MIN_URLS / n), minConfidence=min_confidence).fit(baskets)
    found = best_rules(model.freqItemsets, n, min_confidence)
    if found.where("verdict = 'block'").isEmpty():                      # allow is what happens anyway
        return none
    named = (found.withColumn("rule_id", F.monotonically_increasing_id()).checkpoint())
    spread = named.select("rule_id", F.posexplode("items").alias("i", "item")).join(items, "item")
    members = spread.groupBy("rule_id").agg(F.sort_array(F.collect_list(F.struct("i", "members"))).alias("m"))
    return named.join(members.select("rule_id", F.col("m.members").alias("members")), "rule_id").checkpoint()


def best_rules(sets: DataFrame, n: int, min_confidence: float) -> DataFrame:
    """(items, verdict, confidence, support) of the rules of frequent sets (items, freq) over ``n`` rows.

    A rule stays if it is surer than every rule of a part of its items with its verdict.
    The surest part of a set is the surest of the sets with one item less and of their
    surest parts, so sets are looked at by size, each with its items taken out in turn.
    """
    is_verdict = F.exists("items", lambda x: x.isin(BLOCK, ALLOW))
    told = F.when(F.array_contains("items", BLOCK), "block").when(is_verdict, "allow")
    plain = sets.select(F.array_sort(F.array_except("items", F.array(F.lit(BLOCK), F.lit(ALLOW)))).alias("items"),
                        told.alias("verdict"), "freq").where(F.size("items") > 0)
    rate = lambda v: F.coalesce(F.max(F.when(F.col("verdict") == v, F.col("freq"))), F.lit(0))
    rated = (plain.groupBy("items").agg(F.max(F.when(F.col("verdict").isNull(), F.col("freq"))).alias("n"),
                                        rate("block").alias("block_n"), rate("allow").alias("allow_n"))
             .select("items", (F.col("block_n") / F.col("n")).alias("block"), (F.col("allow_n") / F.col("n")).alias("allow"),
                     "block_n", "allow_n").checkpoint())
    largest = rated.agg(F.max(F.size("items"))).first()[0] or 0
    done, last = None, None
    for size in range(1, largest + 1):
        now = rated.where(F.size("items") == size)
        if last is None:
            now = now.withColumn("block_part", F.lit(-1.0)).withColumn("allow_part", F.lit(-1.0))
        else:
            part = F.explode(F.transform("items", lambda x: F.filter("items", lambda y: y != x))).alias("items")
            surest = (now.select(F.col("items").alias("whole"), part)
                      .join(last.select("items", F.greatest("block", "block_part").alias("b"), F.greatest("allow", "allow_part").alias("a")), "items")
                      .groupBy("whole").agg(F.max("b").alias("block_part"), F.max("a").alias("allow_part")))
            now = now.join(surest.withColumnRenamed("whole", "items"), "items")
        last = now.checkpoint()
        done = last if done is None else done.unionByName(last)
    if done is None:
        return sets.sparkSession.createDataFrame([], "items array<string>, verdict string, confidence double, support double")
    one = [F.struct(F.lit(v).alias("verdict"), F.col(v).alias("confidence"), (F.col(f"{v}_n") / n).alias("support"),
                    F.col(f"{v}_part").alias("part")) for v in ("block", "allow")]
    return (done.select("items", F.explode(F.array(*one)).alias("r")).select("items", "r.*")
            .where((F.col("confidence") >= min_confidence) & (F.col("confidence") > F.col("part"))).drop("part"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined) of the distinct ``urls`` (host, path, url) that a rule fits.

    The index holds each rule under the tokens of the one of its items that the fewest
    rules have; a url that has one of these is tested for a token of every other item.
    """
    if "members" not in rules.columns:
        rules = rules.withColumn("members", F.transform("items", lambda x: F.array(x)))
    held = rules.select("rule_id", F.posexplode("items").alias("i", "item"))
    rare = (held.join(held.groupBy("item").agg(F.count("*").alias("n")), "item")
            .groupBy("rule_id").agg(F.min(F.struct("n", "item", "i")).alias("least")).select("rule_id", "least.i"))
    index = rules.join(rare, "rule_id").select(F.explode(F.col("members")[F.col("i")]).alias("token"), "members", "verdict",
                                               "confidence", "support")
    small = rules.count() <= BROADCAST_RULES
    has_all = F.forall("members", lambda m: F.arrays_overlap(m, F.col("has")))
    met = (urls.select("url", tokens("host", "path", "url").alias("has")).select("url", "has", F.explode_outer("has").alias("token"))
           .join(F.broadcast(index) if small else index, "token").where(has_all))
    best = F.max(F.struct("confidence", "support", "verdict")).alias("best")                # block > allow by name
    return met.groupBy("url").agg(best).select("url", F.col("best.verdict").alias("mined"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, mined) of every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    judged = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    judged = judged.withColumn("fit", curated_rule(F.col("host"), F.col("path")))
    asked = F.col("fit").isNull() & F.col("url").isNotNull()
    ensure_checkpoint_dir(pages.sparkSession)
    mined = match_rules(judged.where(asked).select("url", "host", "path").distinct(), rules).checkpoint()
    few = F.broadcast(mined) if mined.count() <= BROADCAST_ROWS else mined
    # null urls and urls of curated rules take no part in the join
    both = judged.where(asked).join(few, "url", "left").unionByName(judged.where(~asked).withColumn("mined", F.lit(None).cast("string")))
    return (both
            .select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce("fit.verdict", "mined", F.lit("allow")).alias("verdict"), "mined"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Urls with a label: a page is bad if its label says low quality or toxic (any of repeated labels)."""
    bad = (labels.where("doc_id is not null").groupBy("doc_id")
           .agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")))
    rows = pages.join(bad, pages.page_id == bad.doc_id).select("url", "blocked")
    return rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = mine_rules(labelled_urls(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
