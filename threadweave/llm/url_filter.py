"""Verdicts on links: explicit host and path rules, and a tree of path templates for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadweave.llm.salting import salted_join
from threadweave.schema import require_columns
from threadweave.session import cut_lineage

ALLOW, BLOCK = "allow", "block"
END = "$"  # a path that goes no deeper
ANY = "*"  # branches merged with each other


@dataclass(frozen=True)
class LinkRule:
    """Applies to a host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def link_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def link_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def post_links(posts: DataFrame, id_column: str = "tweet_id", text_column: str = "text") -> DataFrame:
    """Every link in the texts of posts as ``(id, url)``, repeats included; null texts hold none."""
    require_columns(posts, [id_column, text_column], "posts")
    found = F.regexp_extract_all(F.col(text_column), F.lit(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"']+"), F.lit(0))
    return posts.select(F.col(id_column).alias(id_column), F.explode(found).alias("url"))


def matching_rule(rules: Sequence[LinkRule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as ``struct<name, verdict>``; null if none does.

    Of equally long ones the first by name. Rules are an argument, so their number is the caller's bound.
    """
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def segment_kind(segment: Column) -> Column:
    """The wildcard of a variable segment: its digits, hexadecimal runs or words, with a file ending kept."""
    ending = F.regexp_extract(segment, r"\.[a-z]{1,5}$", 0)
    stem = F.regexp_replace(segment, r"\.[a-z]{1,5}$", "")
    kind = (
        F.when(stem.rlike("^[0-9]+$"), F.lit("{number}"))
        .when(stem.rlike("^[0-9a-fA-F-]{8,}$"), F.lit("{hash}"))
        .when(stem.rlike("[0-9]"), F.lit("{mixed}")).otherwise(F.lit("{word}"))
    )
    return F.concat(kind, ending)


def filter_links(
    links: DataFrame, rules: Sequence[LinkRule], id_column: str = "tweet_id", url_column: str = "url",
    repeats: float = 1.5, outlier: float = 4.0, smoothing: float = 4.0, reject_from: float = 0.8, z: float = 1.96,
) -> DataFrame:
    """One row per link: the id, ``host, path, rule, verdict, template, purity``.

    The longest fitting rule decides; its name stands in ``rule`` and it labels the link. The others
    are judged by their path template. Per host a tree of the distinct paths grows level by level. At each place the
    segments of one kind are variable, and become a wildcard of their kind, if they hardly repeat: fewer than
    ``repeats`` paths to a segment. A single segment stays literal there too if its paths exceed the mean by more than
    ``outlier`` standard deviations of a random (Poisson) count. Sibling branches, two at least, whose labelled block
    rates do not differ from their parent's pooled rate (two-sided test at ``z``) merge; branches without labels do not.
    A template is rejected if its purity, the share of blocks among its labelled paths smoothed towards one half
    with weight ``smoothing``, reaches ``reject_from``, whatever share of its paths has labels: the smoothing
    guards against few labels. A template without labels is allowed.

    The tree grows as long as a branch holds paths with and without label: the rounds are as many as the segments
    that such paths share. In other branches nothing is left to tell apart, so all further segments become
    wildcards in one step.

    Null urls and those without ``://`` have empty host and path, no rule, and are allowed. Null ids and
    repeated rows stay; other columns are not read; an empty table gives an empty result. Repeats of a path are
    one in the tree, rows of a hot host are counted by segment before they are shuffled, and what is joined back is salted.
    """
    require_columns(links, [id_column, url_column], "links")
    url = F.col(url_column).cast("string")
    given = cut_lineage(links.select(F.col(id_column).alias("_id"), link_host(url).alias("host"), link_path(url).alias("path")))
    rows = given.select("host", "path").distinct().withColumn("_rule", matching_rule(rules, F.col("host"), F.col("path")))
    rows = rows.select(
        "host", "path", F.col("_rule.name").alias("rule"), F.col("_rule.verdict").alias("label"),
        F.expr("array_remove(split(path, '/'), '')").alias("_segments"), F.lit("").alias("template"),
    )
    done, level = [], 0
    while not (level and rows.isEmpty()):
        rows = cut_lineage(rows.withColumn("_segment", F.coalesce(F.get("_segments", F.lit(level)), F.lit(END))))
        grown = cut_lineage(_grow(rows, repeats, outlier, z))
        level += 1
        ended = F.size("_segments") < level
        tail = F.transform(F.slice("_segments", level + 1, F.greatest(F.size("_segments"), F.lit(1))), segment_kind)
        whole = F.when(ended, F.col("template")).otherwise(F.concat_ws("/", "template", tail, F.lit(END)))
        done.append(grown.filter(ended | ~F.col("_open")).withColumn("template", whole).drop("_open"))
        rows = grown.filter(~ended & F.col("_open")).drop("_open")
    rows = done[0]
    for part in done[1:]:
        rows = rows.unionByName(part)
    rows = cut_lineage(rows)
    labelled, blocked = F.count("label"), F.count_if(F.col("label") == BLOCK)
    purity = rows.groupBy("host", "template").agg(
        ((blocked + smoothing / 2) / (labelled + smoothing)).alias("purity"),
    )
    by_template = F.when((F.col("host") != "") & (F.col("purity") >= reject_from), BLOCK).otherwise(ALLOW)
    judged = salted_join(rows, purity, ["host", "template"], ["path"]).select(
        "host", "path", "rule", F.coalesce("label", by_template).alias("verdict"), "template", "purity"
    )
    return salted_join(given, judged, ["host", "path"], ["_id"]).select(
        F.col("_id").alias(id_column), "host", "path", "rule", "verdict", "template", "purity"
    )


def _grow(rows: DataFrame, repeats: float, outlier: float, z: float) -> DataFrame:
    """Add one level to every path's template; ``_open`` says whether its branch holds paths with and without label."""
    at = ["host", "template"]
    labelled, blocked = F.count("label").alias("labelled"), F.count_if(F.col("label") == BLOCK).alias("blocked")
    kind = F.when(F.col("_segment") == END, F.lit(END)).otherwise(segment_kind(F.col("_segment")))
    segments = cut_lineage(
        rows.groupBy(*at, "_segment").agg(F.count(F.lit(1)).alias("paths"), labelled, blocked).withColumn("_kind", kind)
    )
    kinds = segments.groupBy(*at, "_kind").agg((F.sum("paths") / F.count(F.lit(1))).alias("mean"))
    literal = (F.col("mean") >= repeats) | (F.col("paths") > F.col("mean") + outlier * F.sqrt("mean"))
    named = salted_join(segments, kinds, [*at, "_kind"], ["_segment"]).withColumn(
        "branch", F.when(literal, F.col("_segment")).otherwise(F.col("_kind"))
    )
    branches = named.groupBy(*at, "branch").agg(
        *[F.sum(c).alias(c) for c in ("paths", "labelled", "blocked")], (F.first("_kind") == END).alias("ends")
    )
    parents = branches.groupBy(*at).agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    pooled = F.try_divide("all_blocked", "all_labelled")  # null without labels
    gap = F.abs(F.try_divide("blocked", "labelled") - pooled)
    similar = ~F.col("ends") & (gap <= z * F.sqrt(F.try_divide(pooled * (1 - pooled), F.col("labelled"))))
    tested = cut_lineage(
        salted_join(branches, parents, at, ["branch"]).select(
            *at, "branch", "paths", "labelled", F.coalesce(similar, F.lit(False)).alias("similar")
        )
    )
    siblings = tested.filter("similar").groupBy(*at).agg(
        F.count(F.lit(1)).alias("siblings"), F.sum("paths").alias("all_paths"), F.sum("labelled").alias("all_labelled")
    ).filter("siblings > 1")
    merged = F.col("similar") & F.col("siblings").isNotNull()
    of_branch = tested.join(siblings, at, "left").select(
        *at, "branch", F.when(merged, F.lit(ANY)).otherwise(F.col("branch")).alias("_step"),
        F.when(merged, F.col("all_paths")).otherwise(F.col("paths")).alias("paths"),
        F.when(merged, F.col("all_labelled")).otherwise(F.col("labelled")).alias("labelled"),
    ).select(*at, "branch", "_step", ((F.col("labelled") > 0) & (F.col("labelled") < F.col("paths"))).alias("_open"))
    steps = salted_join(named.select(*at, "branch", "_segment"), of_branch, [*at, "branch"], ["_segment"])
    joined = salted_join(rows, steps.drop("branch"), [*at, "_segment"], ["path"])
    return joined.withColumn("template", F.concat("template", F.lit("/"), "_step")).drop("_segment", "_step")
