"""Main text of pages: a style tree of each site tells branches that carry its articles from those its pages share.

The pages of a host are merged by the paths of block elements, with their names and by tags alone. A path's content importance is
the entropy of the texts at it, its presentation importance that of how it presents its children, each
over the log of how many different pages it is on, so 0 is all equal and 1 all different. A branch's
importance is the mean content importance under it together with its own presentation: an article's
paragraphs differ in number and kind from page to page, a menu, advert or footer is built alike on each.

One rule holds for any number of pages: an importance from n pages counts as n - 1 of n - 1 + PRIOR_PAGES, the rest is
that of the path by tags alone in the same way, and the rest of that is what names and lengths say of the block. So a site's only
page is judged by these, names that no other page has leave it to the tags, and of many pages their texts decide.
From every page those branches go that are less important than its most important one by a margin, and of
the rest the blocks whose own content is low. What markup names is a prior besides, as far as pages decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.html_blocks import ARTICLE, CHROME, COMMENTS, MAIN, NAMED, NEUTRAL, Page, parsed
from lodestone.llm.stored import broadcast_if_small, read, small_batches, spread, stored
from lodestone.llm.text_arrays import slices, windows, word_hashes, word_spans

#: Weight of content against presentation in a branch, and how many pages what is coarser counts for.
CONTENT_WEIGHT, PRIOR_PAGES = 0.5, 3
#: A branch goes under this importance, and so far below the page's best one; a block goes under LOW.
FLOOR, MARGIN, LOW = 0.3, 0.15, 0.3
#: What a block's state adds to the importance of its branch.
BRANCH_PRIOR = {COMMENTS: -0.5, CHROME: -0.3, NAMED: 0.2, NEUTRAL: 0.0, MAIN: 0.15, ARTICLE: 0.2}
#: The importance of a branch that names keep: not less than any other's. It counts for the branch, but not against others.
KEPT = 1 + max(BRANCH_PRIOR.values())
#: What it adds to the block's own.
BLOCK_PRIOR = {COMMENTS: -0.3, CHROME: -0.3, NAMED: -0.3, NEUTRAL: 0.0, MAIN: 0.15, ARTICLE: 0.2}
#: The same for blocks without a name beside a main part that is longer than all of them.
BESIDE = -0.3
_BLOCK = pa.struct([("branches", pa.list_(pa.int64())), ("plain", pa.list_(pa.int64())), ("prior", pa.float64()), ("least", pa.float64()), ("kept", pa.bool_())])
#: Of a block's text and of an element's children: paths with names and by tags, what is there, and the page.
CONTENT = ["path", "plain", "feature", "page"]
STYLE = ["path", "plain", "feature", "plain_feature", "page"]
_BLOCKS = "array<struct<branches: array<long>, plain: array<long>, prior: double, least: double, kept: boolean>>"


def _schema(names: list[str]) -> str:
    return f"array<struct<{', '.join(f'{n}: long' for n in names)}>>"


SCHEMA = f"page_id long, url string, host string, texts array<string>, blocks {_BLOCKS}, shared int, contents {_schema(CONTENT)}, styles {_schema(STYLE)}"


def _content(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 ^ zlib.crc32(data[::-1]) >> 1


def _least_pairs(texts: list[str]) -> list[int]:
    """Of each text the smallest hash of two words in a row (of its word, if it has one), which near copies mostly share."""
    found = np.zeros(len(texts), np.uint64)
    for row, data, offsets in slices(pa.array(texts, pa.string())):
        starts, ends, first = word_spans(data, offsets)
        hashes = word_hashes(data, starts, ends, lower=False)
        pairs, at = windows(hashes, first, 2)
        several, alone = np.flatnonzero(np.diff(at)), np.flatnonzero(np.diff(first) == 1)
        if len(several):
            found[row + several] = np.minimum.reduceat(pairs, at[several])
        found[row + alone] = hashes[first[alone]]
    return (found >> np.uint64(1)).astype(np.int64).tolist()


def _lists(values: pa.Array, counts: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), pa.int32()), values)


def _nodes(rows: list[tuple[int, ...]], names: list[str], counts: list[int]) -> pa.Array:
    columns = np.array(rows, np.int64).reshape(-1, len(names))
    return _lists(pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(len(names))], names), counts)


def columns_of(pages: list[Page]) -> list[pa.Array]:
    """Of pages their texts, blocks, how many of their outer branches all blocks share, and nodes for the style tree.

    least: the content importance from which a block stays; kept: whether names and lengths keep it.
    page, of a node: what tells the rest of the page from other pages, but not from its near copies.
    """
    texts = [b.text for page in pages for b in page.blocks]
    pairs = _least_pairs(texts)
    branches, plain, depths, priors, least, kept, shares, contents, styles, n_styles = [], [], [], [], [], [], [], [], [], []
    at = 0
    for page in pages:
        blocks, own = page.blocks, pairs[at : at + len(page.blocks)]
        at += len(blocks)
        main = sum(len(b.text) for b in blocks if b.state >= MAIN)
        beside = sum(len(b.text) for b in blocks if b.state == NEUTRAL)
        # an article shorter than all that has no name is a teaser or a part
        least_state = MAIN if main and main >= beside else NEUTRAL if beside else NAMED
        first, second = (sorted(set(own)) + [-1, -1])[:2]
        shared, shortest = 0, min((len(b.branches) for b in blocks), default=0)
        while shared < shortest and all(b.branches[shared] == blocks[0].branches[shared] for b in blocks):
            shared += 1
        shares.append(shared)
        for b, pair in zip(blocks, own, strict=True):
            branches += b.branches
            plain += b.plain
            depths.append(len(b.branches))
            priors.append(BRANCH_PRIOR[b.state])
            least.append(LOW - (BESIDE if b.state == NEUTRAL and least_state == MAIN else BLOCK_PRIOR[b.state]))
            kept.append(b.state >= least_state)
            contents.append((b.branches[-1], b.plain[-1], _content(b.text), second if pair == first else first))
        own_styles = [(*paths, *style, first) for paths, found in page.elements.items() for style in found] if blocks else []
        styles += own_styles
        n_styles.append(len(own_styles))
    counts = [len(page.blocks) for page in pages]
    whole = pa.StructArray.from_arrays([_lists(pa.array(branches, pa.int64()), depths), _lists(pa.array(plain, pa.int64()), depths), pa.array(priors, pa.float64()), pa.array(least, pa.float64()), pa.array(kept, pa.bool_())], fields=list(_BLOCK))
    return [_lists(pa.array(texts, pa.string()), counts), _lists(whole, counts), pa.array(shares, pa.int32()), _nodes(contents, CONTENT, counts), _nodes(styles, STYLE, n_styles)]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 250):
            batch = whole.slice(k, 250)
            columns = columns_of([parsed(page or "") for page in batch.column("html").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *columns], ["page_id", "url", "host", "texts", "blocks", "shared", "contents", "styles"])


def entropies(sites: DataFrame, nodes: str, path: str = "path", feature: str = "feature") -> DataFrame:
    """(host, path, entropy from 0 to 1, pages) of the features at each path, of `nodes` of sites.

    A feature counts as the number of different pages it is on, as the exponent of their entropy: copies of a
    page and most of its near copies are one page. Equal ones all over give 0; one place alone gives 1.
    """
    node = F.col("node")
    counts = sites.select("host", F.explode(nodes).alias("node")).groupBy("host", node[path].alias("path"), node[feature].alias("feature"), node["page"].alias("page")).agg(F.count("*").alias("c"))
    seen = counts.groupBy("host", "path", "feature").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.ln("c")).alias("logs"))
    n = seen.select("host", "path", F.greatest(F.exp(F.ln("all") - F.col("logs") / F.col("all")), F.lit(1.0)).alias("n"))
    total = n.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("logs"))
    # of shares n / pages: -sum(n / pages * ln(n / pages)) / ln(pages)
    return total.select("host", "path", F.when(F.col("pages") > 1.0001, 1 - F.col("logs") / (F.col("pages") * F.ln("pages"))).otherwise(1.0).alias("entropy"), "pages")


def _by_path(sites: DataFrame, path: str, feature: str, branches: str) -> tuple[DataFrame, DataFrame]:
    """(content, branch): (host, path, entropy, pages) of the texts at each path, and (host, path, importance, pages) of each branch that holds some.

    A branch's pages are those of the path under it that is on most.
    """
    content = entropies(sites, "contents", path)
    around = sites.select("host", F.explode(f"blocks.{branches}").alias("branches")).groupBy("host", F.element_at("branches", -1).alias("path")).agg(F.first("branches").alias("branches"))
    under = content.join(around, ["host", "path"]).select("host", F.explode("branches").alias("path"), "entropy", "pages")
    mean = under.groupBy("host", "path").agg((F.sum(F.col("entropy") * F.col("pages")) / F.sum("pages")).alias("mean"), F.max("pages").alias("pages"))
    styles = entropies(sites, "styles", path, feature).select("host", "path", F.col("entropy").alias("style"))
    importance = CONTENT_WEIGHT * F.col("mean") + (1 - CONTENT_WEIGHT) * F.coalesce("style", F.lit(0.0))
    return content, mean.join(styles, ["host", "path"], "left").select("host", "path", importance.alias("importance"), "pages")


def _shrunk(value: Column, pages: Column, coarse: Column, coarse_pages: Column) -> Column:
    """struct<known, names>: an importance is known + names * that of names and lengths."""
    w, u = F.greatest(pages - 1, F.lit(0.0)), F.greatest(coarse_pages - 1, F.lit(0.0))
    k = F.lit(float(PRIOR_PAGES))
    return F.struct(((w * value + k * u * coarse / (u + k)) / (w + k)).alias("known"), (k * k / ((u + k) * (w + k))).alias("names"))


def importances(sites: DataFrame) -> DataFrame:
    """(host, path, content, branch): of the paths that have texts and the branches that hold them, both struct<known, names>; content is null where there is no text."""
    content, branch = _by_path(sites, "path", "feature", "branches")
    plain_content, plain_branch = (side.select("host", F.col("path").alias("plain"), F.col(side.columns[2]).alias("coarse"), F.col("pages").alias("coarse_pages")) for side in _by_path(sites, "plain", "plain_feature", "plain"))
    pairs = sites.select("host", F.explode("blocks").alias("b")).select("host", "b.branches", "b.plain").groupBy("host", F.element_at("branches", -1).alias("last")).agg(F.first("branches").alias("branches"), F.first("plain").alias("plain"))
    tags = pairs.select("host", F.explode(F.arrays_zip("branches", "plain")).alias("z")).select("host", F.col("z.branches").alias("path"), F.col("z.plain").alias("plain")).distinct()
    one = lambda side, coarse: side.join(tags, ["host", "path"]).join(coarse, ["host", "plain"]).select("host", "path", _shrunk(F.col(side.columns[2]), F.col("pages"), F.col("coarse"), F.col("coarse_pages")).alias("own"))
    return one(branch, plain_branch).withColumnRenamed("own", "branch").join(one(content, plain_content).withColumnRenamed("own", "content"), ["host", "path"], "left").select("host", "path", "content", "branch")


def _judged(tree: Column) -> Column:
    """Of each block of a page whether it stays."""

    def branch(b: Column) -> Column:
        own = F.slice(b["branches"], F.least(F.col("shared") + 1, F.size(b["branches"])), F.size(b["branches"]))
        found = F.transform(own, lambda path: F.try_element_at(tree, path)["branch"])
        known = lambda s: s["known"] + (1 - s["names"]) * b["prior"]
        return F.struct(F.array_max(F.transform(found, known)).alias("known"), F.array_max(F.transform(found, lambda s: known(s) + s["names"] * F.when(b["kept"], KEPT).otherwise(0.0))).alias("most"))

    def content(b: Column) -> Column:
        found = F.array(F.try_element_at(tree, F.element_at(b["branches"], -1))["content"])
        return F.get(F.transform(found, lambda s: s["known"] + s["names"] * b["kept"].cast("int")), F.lit(0))

    scored = F.transform("blocks", lambda b: F.struct(content(b).alias("content"), branch(b).alias("branch"), b["least"].alias("least")))
    # arrays of one element are names for what is used for each block, so that it is evaluated once for the page
    best = lambda found: F.array_max(F.transform(found, lambda s: s["branch"]["known"]))
    page = F.transform(F.array(scored), lambda found: F.struct(found.alias("blocks"), F.greatest(F.lit(FLOOR), best(found) - MARGIN).alias("lowest")))
    stays = lambda s, lowest: (s["content"] >= s["least"]) & (s["branch"]["most"] >= lowest)
    return F.get(F.transform(page, lambda p: F.transform(p["blocks"], lambda s: stays(s, p["lowest"]))), F.lit(0))


def judged_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, texts, stay, kept: of each page its blocks, whether each stays, and whether names alone would keep it."""
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), F.col("html").cast("string"))
    sites = stored(rows.mapInArrow(_parsed, SCHEMA), "parsed")
    branch = F.struct("path", F.struct("content", "branch"))
    trees = stored(importances(sites).groupBy("host").agg(F.map_from_entries(F.collect_list(branch)).alias("tree")), "trees")
    whole = sites.join(broadcast_if_small(trees, 20_000), "host", "left")
    return whole.select("page_id", "url", "texts", _judged(F.col("tree")).alias("stay"), F.col("blocks.kept").alias("kept"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html); other columns are ignored.

    text: the main part's blocks joined by two line feeds, empty if none. A null html is empty. Forms, scripts and styles
    are no text. Of the other blocks, those stay whose branch is about as important to the
    site as the page's best one and whose content differs from page to page, with a prior of what markup
    names; the fewer pages have a block's path, the more counts whether it is in a named article or main
    part, or if that is missing or shorter than what has no name. Pages without a host (null or without
    ://) are one site. Repeated rows get equal answers.
    """
    judged = judged_blocks(pages)
    kept = F.filter(F.arrays_zip("texts", "stay"), lambda z: z["stay"])
    return judged.select("page_id", "url", F.array_join(F.transform(kept, lambda z: z["texts"]), "\n\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spread(read(spark, sf_dir, "pages")))
