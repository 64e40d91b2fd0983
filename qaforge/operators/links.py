"""Links between pages and the planning of a crawl over stored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaforge.functions import urls as U
from qaforge.functions.common import LINE_BREAK, strip
from qaforge.rules import lexicons as R
from qaforge.session import cut_lineage

# Frontier rows that may be sent to every task; a longer frontier is joined by shuffling.
BROADCAST_ROWS = 200_000
# Shares a page's links are cut into when shuffled, so that a hub with very many links fills several tasks.
HUB_SHARES = 16

# Fixed pattern: an anchor tag up to its address, quoted or bare.
_HREF = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"


def extract_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(src, href, pos): every anchor with an address, in order, straight from the markup."""
    found = F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(1))
    return pages.select(F.col(url).alias("src"), F.posexplode(found).alias("pos", "raw")).select(
        "src", F.replace(F.regexp_replace("raw", "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")).alias("href"), "pos"
    )


def resolve_links(links: DataFrame, base: str | None = None) -> DataFrame:
    """(src, dst, pos): absolute addresses without fragments, resolved against the page or a fixed base."""
    root = F.lit(base) if base else F.col("src")
    return links.select("src", U.normalize_url(root, F.col("href")).alias("dst"), "pos")


def same_domain(links: DataFrame, url: str = "dst", base: Column | str = "src") -> DataFrame:
    return links.filter(U.same_domain(F.col(url), F.col(base) if isinstance(base, str) else base))


def drop_assets(links: DataFrame, url: str = "dst", suffix_only: bool = False) -> DataFrame:
    return links.filter(~U.is_asset(F.col(url), suffix_only))


def drop_trap_urls(links: DataFrame, url: str = "dst", base: Column | str = "src") -> DataFrame:
    return links.filter(~U.is_trap(F.col(url), F.col(base) if isinstance(base, str) else base))


def keep_keyword_urls(
    links: DataFrame, cues: Sequence[str] = tuple(R.HELP_URL_WORDS), url: str = "dst",
    fallback_all: bool = False, cap: int | None = None, order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Addresses with any of the words; with `fallback_all` all of them if none has one; then the first `cap`."""
    hit = U.has_keyword(F.col(url), cues)
    out = links.filter(hit)
    if fallback_all:
        # One-row aggregate joined back, so the decision costs no separate pass over the links.
        some = links.agg(F.max(hit.cast("int")).alias("_any"))
        out = (
            links.withColumn("_one", F.lit(1))
            .join(F.broadcast(some.withColumn("_one", F.lit(1))), "_one")
            .filter(hit | (F.coalesce(F.col("_any"), F.lit(0)) == 0))
            .select(*links.columns)
        )
    return out.orderBy(*order).limit(cap) if cap else out


def distinct_links(links: DataFrame) -> DataFrame:
    """One row per link, at its first place."""
    return links.groupBy("src", "dst").agg(F.min("pos").alias("pos"))


def page_links(pages: DataFrame, cues: Sequence[str] | None = tuple(R.HELP_URL_WORDS)) -> DataFrame:
    """All link rules in a row: resolve, same site, no assets, no traps, help words, first of each."""
    links = drop_trap_urls(drop_assets(same_domain(resolve_links(extract_links(pages)))))
    return distinct_links(keep_keyword_urls(links, cues) if cues else links)


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int = 3, check_domain: bool = True) -> DataFrame:
    """(url, depth): every address at the first depth it is reached, level by level.

    `edges(src, dst)`, `roots(url)`. With `check_domain`, a level only follows links whose site is that of a root.
    Each level joins the frontier with the links. A short frontier is broadcast; a long one is joined on
    (page, share), so that a hub page does not become one task.
    """
    links = edges.select("src", "dst").filter("dst is not null")
    if check_domain:
        sites = roots.select(U.authority(F.col("url")).alias("_site")).distinct()
        links = links.withColumn("_site", U.authority(F.col("dst"))).join(sites, "_site", "left_semi").drop("_site")
    links = cut_lineage(links.distinct().withColumn("share", F.pmod(F.xxhash64("dst"), F.lit(HUB_SHARES)).cast("int")))
    frontier = cut_lineage(roots.select("url").distinct())
    seen = cut_lineage(frontier.withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        size = frontier.count()
        if size == 0:
            break
        if size <= BROADCAST_ROWS:
            reached = links.join(F.broadcast(frontier), links["src"] == frontier["url"])
        else:
            shares = frontier.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(HUB_SHARES - 1))))
            reached = links.join(shares, (links["src"] == shares["url"]) & (links["share"] == shares["share"]))
        fresh = reached.select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        frontier = cut_lineage(fresh)
        seen = cut_lineage(seen.unionByName(frontier.withColumn("depth", F.lit(depth))))
    return seen


def crawl_report(pages: DataFrame, visited: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visited addresses that have a stored page, the ones that failed, and the pairs of the visited by context.

    `pages(url, context)`, `visited(url, …)`, `pairs(url, pos, question, answer)`.
    """
    seen = visited.select("url").distinct()
    known = pages.select("url").distinct()
    done = seen.join(known, "url", "left_semi")
    failed = seen.join(known, "url", "left_anti")
    by_context = pairs.join(done, "url", "left_semi").join(
        pages.groupBy("url").agg(F.min("context").alias("context")), "url"
    )
    return done, failed, by_context.select("context", "url", "pos", "question", "answer")


def skip_processed(pages: DataFrame, store: DataFrame, by: str = "url") -> DataFrame:
    """Pages whose address (or whole site, `by="site"`) is not in the store yet."""
    if by == "site":
        done = store.select(U.site_name(F.col("url")).alias("_site")).distinct()
        keyed = pages.withColumn("_site", U.site_name(F.col("url")))
        return keyed.join(done, "_site", "left_anti").drop("_site")
    return pages.join(store.select(by).distinct(), by, "left_anti")


def robots_sitemaps(robots: DataFrame, site: str = "site", body: str = "body") -> DataFrame:
    """(site, pos, sitemap): addresses named in robots files; two common places for a site that names none."""
    rows = F.filter(
        F.transform(
            F.filter(F.split(F.coalesce(F.col(body), F.lit("")), LINE_BREAK), lambda s: F.lower(s).startswith("sitemap:")),
            lambda s: strip(F.regexp_replace(s, "^[^:]*:", "")),
        ),
        lambda s: s != "",
    )
    root = F.concat(U.scheme(F.col(site)), F.lit("://"), U.authority(F.col(site)))
    usual = F.array(F.concat(root, F.lit("/sitemap.xml")), F.concat(root, F.lit("/sitemap_index.xml")))
    chosen = F.when(F.size(rows) > 0, rows).otherwise(usual)
    return robots.select(site, F.posexplode(chosen).alias("pos", "sitemap"))


def expand_sitemap_index(
    entries: DataFrame, roots: DataFrame, cap: int | None = None, max_rounds: int | None = None
) -> DataFrame:
    """(loc, path): page addresses of sitemaps and of the sitemaps they name, first place of each, in reading order.

    `entries(sitemap, kind, pos, loc)` with kind `sitemap` or `url` as read_sitemaps gives them; `roots(sitemap, pos)`.
    `path` is the place in the tree and sorts in reading order, sub-sitemaps before own pages. A sitemap is opened once, so
    cycles end. The tree is followed to its end; with `max_rounds` a deeper tree is an error, never a shorter result.
    """
    front = cut_lineage(roots.select("sitemap", F.array(F.col("pos").cast("long")).alias("path")))
    front = first_seen = cut_lineage(front.groupBy("sitemap").agg(F.min("path").alias("path")))
    pages: DataFrame | None = None
    rounds = 0
    while not front.isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise ValueError(f"sitemaps are nested deeper than {max_rounds}")
        rounds += 1
        rows = entries.join(front, "sitemap")
        order = F.when(F.col("kind") == "sitemap", F.lit(0)).otherwise(F.lit(1)).cast("long")
        placed = cut_lineage(
            rows.select("kind", "loc", F.concat("path", F.array(order, F.col("pos").cast("long"))).alias("path"))
        )
        found = placed.filter("kind = 'url'").select("loc", "path")
        pages = found if pages is None else pages.unionByName(found)
        children = placed.filter("kind = 'sitemap'").groupBy(F.col("loc").alias("sitemap")).agg(F.min("path").alias("path"))
        front = cut_lineage(children.join(first_seen.select("sitemap"), "sitemap", "left_anti"))
        first_seen = cut_lineage(first_seen.unionByName(front))
    if pages is None:
        return entries.limit(0).select("loc", F.array(F.lit(0).cast("long")).alias("path"))
    out = pages.groupBy("loc").agg(F.min("path").alias("path"))
    return out.orderBy("path").limit(cap) if cap else out
