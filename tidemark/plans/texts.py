"""Names, codes, addresses, pages and text sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import moderation
from tidemark.functions import text as t
from tidemark.operators.delivery import ics_feed, json_ld
from tidemark.plans.base import query
from tidemark.sources import domain as d
from tidemark.sources import payloads


@query("names_normal", "SELECT set_id, regexp_replace(regexp_replace(lower(name || ' (' || code || ')'), '\\([^)]*\\)', '', 'g'), '[^a-z0-9]+', '', 'g') AS key FROM product_sets")
def names_normal(spark, sf_dir):
    return d.product_sets(spark, sf_dir).select("set_id", t.normal_name(F.concat("name", F.lit(" ("), "code", F.lit(")"))).alias("key"))


@query("codes_normal", "SELECT set_id, regexp_replace(upper(code), '[^A-Z0-9]+', '', 'g') AS code FROM product_sets")
def codes_normal(spark, sf_dir):
    return d.product_sets(spark, sf_dir).select("set_id", t.normal_code(F.col("code")).alias("code"))


@query("codes_in_names", "SELECT set_id, CASE WHEN set_id % 2 = 0 THEN 'ME' || lpad(CAST(size AS VARCHAR), 2, '0') END AS code FROM product_sets")
def codes_in_names(spark, sf_dir):
    code = F.concat(F.lit("ME"), F.lpad(F.col("size").cast("string"), 2, "0"))
    name = F.when(F.col("set_id") % 2 == 0, F.concat(code, F.lit(": "), "name")).otherwise(F.col("name"))
    return d.product_sets(spark, sf_dir).select("set_id", t.code_in_name(name).alias("code"))


@query("slugs_unique", "SELECT set_id, CASE WHEN n = 1 THEN base ELSE base || '-' || set_id END AS slug FROM (SELECT set_id, replace(name, ' ', '-') AS base, row_number() OVER (PARTITION BY install_id, replace(name, ' ', '-') ORDER BY set_id) AS n FROM product_sets)")
def slugs_unique(spark, sf_dir):
    from tidemark.operators.snapshots import slugs

    return slugs(d.product_sets(spark, sf_dir), t.slug(F.col("name"))).select("set_id", "slug")


@query("codes_synthetic", "SELECT set_id, 'SYN-' || substr(replace(upper(name), ' ', '-'), 1, 24) || '-' || upper(substr(sha256(name), 1, 6)) AS code FROM product_sets")
def codes_synthetic(spark, sf_dir):
    return d.product_sets(spark, sf_dir).select("set_id", t.synthetic_code(F.col("name")).alias("code"))


@query("colors", "SELECT DISTINCT name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 4294967295) % 8 AS color FROM product_sets")
def colors(spark, sf_dir):
    return d.product_sets(spark, sf_dir).select("name").distinct().select("name", t.color_index(F.col("name"), 8).alias("color"))


@query("page_urls", r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, nullif(regexp_replace(regexp_extract(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '([^/]+)/*$', 1), '\.[A-Za-z0-9]+$', ''), '') AS segment FROM pages")
def page_urls(spark, sf_dir):
    return d.read(spark, sf_dir, "pages").select("page_id", t.host(F.col("url")).alias("host"), t.last_segment(F.col("url")).alias("segment"))


@query("page_webhooks", "SELECT page_id, page_id % 5 = 0 AS ok FROM pages")
def page_webhooks(spark, sf_dir):
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://discord.com/api/webhooks/"), F.col("page_id").cast("string"), F.lit("/tok_en-1"))).otherwise(F.col("url"))
    return d.read(spark, sf_dir, "pages").select("page_id", t.is_webhook(url).alias("ok"))


@query("page_slim", r"SELECT page_id, length(regexp_replace(regexp_replace(html, '(?is)<(script|style|svg)\b.*?</(script|style|svg)>', '', 'g'), '(?i)<(link|meta)\b[^>]*>', '', 'g')) AS chars FROM pages")
def page_slim(spark, sf_dir):
    return d.read(spark, sf_dir, "pages").select("page_id", F.length(payloads.slim(F.col("html"))).cast("bigint").alias("chars"))


@query("page_links", """SELECT page_id, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links, CAST(len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS BIGINT) AS distinct_links FROM pages""")
def page_links(spark, sf_dir):
    links = payloads.links(F.col("html"))
    return d.read(spark, sf_dir, "pages").select("page_id", F.size(links).cast("bigint").alias("links"), F.size(F.array_distinct(links)).cast("bigint").alias("distinct_links"))


@query("page_tables", r"SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<table\b')) AS INTEGER) AS tables, CAST(len(regexp_extract_all(html, '(?i)<tr\b')) AS INTEGER) AS rows FROM pages")
def page_tables(spark, sf_dir):
    grids = payloads.tables(F.col("html"))
    return d.read(spark, sf_dir, "pages").select("page_id", F.size(grids).alias("tables"), F.aggregate(grids, F.lit(0), lambda n, g: n + F.size(g)).alias("rows"))


@query("payload_hash_skip", "SELECT page_id FROM pages WHERE sha256(html) NOT IN (SELECT sha256(html) FROM pages WHERE page_id % 2 = 0)")
def payload_hash_skip(spark, sf_dir):
    pages = d.read(spark, sf_dir, "pages").withColumn("sha256", F.sha2("html", 256))
    return payloads.changed(pages, pages.where("page_id % 2 = 0").select("sha256")).select("page_id")


@query("payload_round_trip", "SELECT page_id, sha256(html) AS sha256, length(html) AS chars FROM pages")
def payload_round_trip(spark, sf_dir):
    packed = payloads.pack(d.read(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return payloads.unpacked(packed.select("page_id", "sha256", "body")).select("page_id", "sha256", F.length("text").cast("bigint").alias("chars"))


@query("rss_items", "SELECT doc_id, 'T' || doc_id AS title, 'https://news.example/' || source || '/' || doc_id AS link, CASE WHEN doc_id % 3 = 0 THEN '2024-05-01' ELSE '2024-06-02' END AS published FROM documents", days=("published",))
def rss_items(spark, sf_dir):
    docs = d.read(spark, sf_dir, "documents").select("doc_id", "source")
    date = F.when(F.col("doc_id") % 3 == 0, F.lit("<pubDate>Wed, 01 May 2024 10:00:00 GMT</pubDate>")).otherwise(F.lit("<date>2024-06-02T00:00:00Z</date>"))
    item = F.concat(F.lit("<rss><channel><item><title>T"), F.col("doc_id").cast("string"), F.lit("</title><link>https://news.example/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("</link>"), date, F.lit("</item></channel></rss>"))
    return payloads.rss(docs.select("doc_id", item.alias("xml")), "xml", "2024-07-01").select("doc_id", "title", "link", "published")


@query("json_catalogue", "SELECT set_id AS external_id, name, code, CASE WHEN set_id % 4 <> 0 THEN DATE '2024-01-01' + CAST(set_id % 300 AS INTEGER) END AS day FROM product_sets", days=("day",))
def json_catalogue(spark, sf_dir):
    """Payloads of an install, taken apart again."""
    item = F.struct(F.col("set_id").alias("groupId"), "name", F.col("code").alias("abbreviation"), F.when(F.expr("set_id % 4 <> 0"), F.expr("cast(date_add(date'2024-01-01', cast(set_id % 300 as int)) as string)")).alias("publishedOn"))
    bodies = d.product_sets(spark, sf_dir).groupBy("install_id", F.expr("set_id div 500")).agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("body"))
    return payloads.catalogue(bodies, "body").select(F.col("group_id").alias("external_id"), "name", "code", "day")


@query("ics_lines", r"SELECT event_id, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || event_id || '@tidemark' || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(coalesce(date_exact, date_start), '%Y%m%d') || chr(13) || chr(10) || 'DTEND;VALUE=DATE:' || strftime(coalesce(date_exact, date_end) + 1, '%Y%m%d') || chr(13) || chr(10) || 'SUMMARY:' || name || chr(13) || chr(10) || 'END:VEVENT' AS vevent FROM release_events JOIN product_sets USING (set_id) WHERE kind IN ('EXACT', 'RANGE') AND NOT archived")
def ics_lines(spark, sf_dir):
    return ics_feed(d.release_events(spark, sf_dir).where("NOT archived").join(d.product_sets(spark, sf_dir), "set_id"))


@query("json_ld", """SELECT event_id, '{"@type":"Event","name":"' || name || '","startDate":"' || coalesce(date_exact, date_start) || '","endDate":"' || coalesce(date_exact, date_end) || '"}' AS json FROM release_events JOIN product_sets USING (set_id) WHERE kind IN ('EXACT', 'RANGE')""")
def json_ld_rows(spark, sf_dir):
    return json_ld(d.release_events(spark, sf_dir).join(d.product_sets(spark, sf_dir), "set_id"))


_NTH = "(conv_id * 7 + turn) % {n}"
_TERMS, _INNOCENT = (f"""list_value({', '.join(f"'{w}'" for w in x)})""" for x in (moderation.TERMS, moderation.INNOCENT))


@query(
    "comments_flagged",
    rf"""WITH comments AS (
        SELECT conv_id, turn, coalesce(text, '') AS text, conv_id % 7 AS kind, {_TERMS}[1 + {_NTH.format(n=len(moderation.TERMS))}] AS term, {_INNOCENT}[1 + {_NTH.format(n=len(moderation.INNOCENT))}] AS word
        FROM conversations WHERE role = 'user'
    ), disguised AS (
        SELECT conv_id, turn, text || ' ' || CASE kind WHEN 0 THEN term WHEN 1 THEN regexp_replace(term, '(.)', '\1 ', 'g') WHEN 2 THEN translate(term, 'aeios', '@31о$') WHEN 3 THEN regexp_replace(upper(term), '([AEIOU])', '\1\1\1', 'g') || '!'
            WHEN 4 THEN word || 's' WHEN 5 THEN '4 5 5 ' || substr(term, 1, 1) || '-' || substr(term, 2, 1) ELSE '' END AS text FROM comments
    ), letters AS (SELECT conv_id, turn, regexp_replace(' ' || regexp_replace(translate(text, '{moderation.LETTERS[0]}', '{moderation.LETTERS[1]}'), '[\t\n\r]', ' ', 'g') || ' ', ' [^a-z@]+ ', ' ', 'g') AS x FROM disguised
    ), words AS (SELECT conv_id, turn, regexp_replace(translate(regexp_replace(x, '!([a-z])', 'i\1', 'g'), '{moderation.SIGNS[0]}', '{moderation.SIGNS[1]}'), '[^a-z]+', ' ', 'g') AS x FROM letters
    ), normal AS (SELECT conv_id, turn, trim(regexp_replace(replace(regexp_replace(x, '\b([a-z])\b', '<\1>', 'g'), '> <', ''), '[<>]', '', 'g')) AS normal FROM words
    ), found AS (SELECT *, list_filter(string_split(normal, ' '), lambda w: regexp_matches(regexp_replace(w, '{moderation.innocent_pattern()}', '.', 'g'), '{moderation.pattern()}')) AS hits FROM normal)
    SELECT conv_id, turn, normal, len(hits) > 0 AS flagged, array_to_string(hits, ' ') AS words FROM found""",
)
def comments_flagged(spark, sf_dir):
    """Users' turns, to which disguised terms, innocent words and numbers are added by the number of the conversation."""
    rows = d.read(spark, sf_dir, "conversations").where("role = 'user'")
    term, word = (F.element_at(F.array(*map(F.lit, x)), (1 + F.expr(_NTH.format(n=len(x)))).cast("int")) for x in (moderation.TERMS, moderation.INNOCENT))
    kinds = [term, F.regexp_replace(term, "(.)", "$1 "), F.translate(term, "aeios", "@31о$"), F.concat(F.regexp_replace(F.upper(term), "([AEIOU])", "$1$1$1"), F.lit("!"))]
    kinds += [F.concat(word, F.lit("s")), F.concat(F.lit("4 5 5 "), F.substring(term, 1, 1), F.lit("-"), F.substring(term, 2, 1))]
    added = F.coalesce(*[F.when(F.expr(f"conv_id % 7 = {k}"), x) for k, x in enumerate(kinds)], F.lit(""))
    normal = rows.select("conv_id", "turn", moderation.normalised(F.concat_ws(" ", F.coalesce("text", F.lit("")), added)).alias("normal"))
    found = normal.withColumn("hits", moderation.flagged_words(F.col("normal")))
    return found.select("conv_id", "turn", "normal", (F.size("hits") > 0).alias("flagged"), F.array_join("hits", " ").alias("words"))
