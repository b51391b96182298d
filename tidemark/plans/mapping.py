"""Payloads written from the domain's tables and mapped back: JSON indexes, publisher pages, details, framing and written spans of days."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.plans.base import query
from tidemark.schema import GAMES
from tidemark.sources import connector
from tidemark.sources import domain as d
from tidemark.sources import mappers as m
from tidemark.sources import payloads

FETCHED = "2024-01-01"
_SHIFTED = "DATE '2023-06-01' + CAST(set_id * 7 % 500 AS INTEGER)"
_KEPT = "DATE '2024-01-01' - 90"


def _sets(spark, sf_dir):
    """Sets with a day around the date of the fetch."""
    sets = d.product_sets(spark, sf_dir).withColumn("day", F.expr("date_add(date'2023-06-01', cast(set_id * 7 % 500 as int))"))
    return sets.withColumns({"fetched": F.lit(FETCHED).cast("date"), "said": F.date_format("day", "MMMM d, yyyy")})


#: Sets in a payload: payloads are many, not long.
_PART = "set_id div 500 AS part"


def _pages(rows, item, *keys):
    """Pages of each install's items, so many to a page as a payload has. The number of partitions is fixed: short rows make long pages."""
    keys = ["install_id", "fetched", F.expr(_PART), *keys]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).groupBy(*keys).agg(F.concat(F.lit("<html><body>"), F.array_join(F.array_sort(F.collect_list(item)), ""), F.lit("</body></html>")).alias("html"))


def _body(rows, item, name):
    items = F.collect_list(item)
    return rows.groupBy("install_id", "fetched", F.expr(_PART)).agg(F.to_json(F.struct(items.alias(name)) if name else items).alias("body"))


_TYPES = ["expansion", "core", "token", "memorabilia", "minigame", "alchemy", "treasure_chest", "vanguard", "promo"]


@query("json_set_index", f"SELECT 'id' || set_id AS id, CASE WHEN set_id % 3 = 0 THEN CAST(set_id + 1000 AS VARCHAR) END AS retail_id, name, 'C' || set_id AS code, CASE WHEN set_id % 7 <> 0 THEN {_SHIFTED} END AS day, CASE set_id % 9 WHEN 0 THEN 'expansion' WHEN 1 THEN 'core' ELSE 'promo' END AS product_kind, CASE WHEN set_id % 2 = 0 THEN 'SYMBOL' END AS image_kind FROM product_sets WHERE set_id % 11 <> 0 AND set_id % 9 IN (0, 1, 8) AND (set_id % 7 = 0 OR {_SHIFTED} >= {_KEPT})", days=("day",))
def json_set_index(spark, sf_dir):
    item = F.struct(
        F.concat(F.lit("id"), "set_id").alias("id"), F.concat(F.lit(" c"), "set_id").alias("code"), F.concat("name", F.lit(" ")).alias("name"), F.when(F.expr("set_id % 7 <> 0"), F.col("day").cast("string")).alias("released_at"),
        d.pick(F.col("set_id") % 9, *_TYPES).alias("set_type"), (F.col("set_id") % 11 == 0).alias("digital"), F.when(F.expr("set_id % 3 = 0"), F.col("set_id") + 1000).alias("tcgplayer_id"), F.when(F.expr("set_id % 2 = 0"), F.lit("i.svg")).alias("icon_svg_uri"),
    )
    found = m.set_index(_body(_sets(spark, sf_dir), item, "data"), "body", "fetched")
    return found.select(F.col("external_ids")["index"].alias("id"), F.try_element_at("external_ids", F.lit("retail")).alias("retail_id"), "name", "code", "day", "product_kind", "image_kind")


@query("json_set_array", f"SELECT 'Y' || set_id % 50 || ':' || name || ' ' || set_id AS external_id, name || ' ' || set_id AS name, 'Y' || set_id % 50 AS code, CASE WHEN set_id % 6 <> 0 THEN {_SHIFTED} END AS day, CASE WHEN set_id % 4 = 0 THEN 'ART' END AS image_kind FROM product_sets WHERE set_id % 13 <> 0 AND (set_id % 6 = 0 OR {_SHIFTED} >= {_KEPT})", days=("day",))
def json_set_array(spark, sf_dir):
    item = F.struct(
        F.when(F.expr("set_id % 13 = 0"), F.lit("  ")).otherwise(F.concat("name", F.lit(" "), "set_id")).alias("set_name"), F.concat(F.lit("Y"), F.col("set_id") % 50).alias("set_code"), F.lit(9).alias("num_of_cards"),
        F.when(F.expr("set_id % 6 <> 0"), F.concat(F.col("day").cast("string"), F.lit("T00:00:00"))).alias("tcg_date"), F.when(F.expr("set_id % 4 = 0"), F.lit("a.jpg")).alias("set_image"),
    )
    return m.set_array(_body(_sets(spark, sf_dir), item, None), "body", "fetched").drop("image_url")


_GAMES = ["magic-the-gathering", "disney-lorcana", "digimon-card-game", "pokemon-tcg", "yugioh-tcg"]
_GROUPS = f"""SELECT set_id AS group_id, CASE install_id WHEN 0 THEN 'magic-the-gathering' WHEN 1 THEN 'disney-lorcana' WHEN 2 THEN 'digimon-card-game' WHEN 3 THEN 'pokemon-tcg' ELSE 'yugioh-tcg' END AS game,
  CASE WHEN set_id % 35 = 10 THEN 'Art Series: set ' || set_id - 5 WHEN set_id % 10 = 7 THEN 'set ' || set_id || ' Pre-release Cards' ELSE 'set ' || set_id END AS name, CAST(set_id % 150 AS VARCHAR) AS code, {_SHIFTED} AS own, set_id % 35 = 10 AS art, set_id % 8 = 3 AS crawled FROM product_sets"""


@query("json_retail_groups", f"WITH g AS ({_GROUPS}), p AS (SELECT g.*, coalesce(CASE WHEN g.art AND NOT q.crawled AND NOT q.art THEN q.own END, CASE WHEN NOT g.crawled THEN g.own END) AS on_day FROM g LEFT JOIN g q ON g.art AND q.group_id = g.group_id - 5 AND q.game = g.game AND q.name = 'set ' || q.group_id) SELECT game, group_id, name, code, 'SHELF' AS type, CASE WHEN game = 'disney-lorcana' AND length(code) <= 2 THEN on_day + 7 ELSE on_day END AS day FROM p WHERE on_day >= {_KEPT} AND NOT (game = 'digimon-card-game' AND group_id % 10 = 7) UNION ALL SELECT game, group_id, name, code, 'PRERELEASE', on_day FROM p WHERE on_day >= {_KEPT} AND game = 'disney-lorcana' AND length(code) <= 2", days=("day",))
def json_retail_groups(spark, sf_dir):
    """Groups of five games, out of one payload for each; a companion series names the set five numbers before it."""
    sets = _sets(spark, sf_dir)
    plain = F.concat(F.lit("set "), "set_id")
    name = F.when(F.expr("set_id % 35 = 10"), F.concat(F.lit("Art Series: set "), F.col("set_id") - 5)).when(F.expr("set_id % 10 = 7"), F.concat(plain, F.lit(" Pre-release Cards"))).otherwise(plain)
    said = F.concat(F.col("day").cast("string"), F.when(F.expr("set_id % 8 = 3"), F.lit("T20:00:07.1172096Z")).otherwise(F.lit("T00:00:00")))
    item = F.struct(F.col("set_id").alias("groupId"), name.alias("name"), (F.col("set_id") % 150).cast("string").alias("abbreviation"), F.expr("set_id % 35 = 10").alias("isSupplemental"), said.alias("publishedOn"))
    bodies = _body(sets, item, "results").withColumn("game", d.pick(F.col("install_id"), *_GAMES))
    schema = "results array<struct<groupId: bigint, name: string, abbreviation: string, isSupplemental: boolean, publishedOn: string>>"
    groups = bodies.select("game", "fetched", F.explode(F.from_json("body", schema)["results"]).alias("g"))
    groups = groups.select("game", "fetched", F.col("g.groupId").alias("group_id"), F.col("g.name").alias("name"), F.col("g.abbreviation").alias("code"), F.col("g.publishedOn").alias("published"), F.col("g.isSupplemental").alias("supplemental"))
    return m.retail_groups(groups, "fetched")


@query(
    "table_cells",
    """WITH s AS (SELECT set_id, set_id // 500 AS page, set_id % 500 AS line, set_id % 5 AS i, name, code, size, lag(code) OVER (PARTITION BY set_id // 500 ORDER BY set_id) AS above FROM product_sets)
    SELECT page, line, col, cells[1 + col] AS cell FROM (SELECT page, line, unnest(range(4)) AS col, ['G' || set_id // 5, name, CASE i WHEN 1 THEN name WHEN 3 THEN above ELSE code END, CAST(size AS VARCHAR)] AS cells FROM s)""",
)
def table_cells(spark, sf_dir):
    """Tables whose first column spans five rows (the last one says more than there are), whose second spans two columns now and then, and whose third two rows."""
    i = F.col("set_id") % 5
    cell = lambda text, attrs="": F.concat(F.lit(f"<td{attrs}>"), text, F.lit("</td>"))
    group = F.concat(F.lit("G"), F.expr("set_id div 5"))
    first = F.when(F.expr("set_id % 500 = 495"), cell(group, " rowspan='50'")).when(i == 0, cell(group, " rowspan=5")).otherwise("")
    named = F.when(i == 1, cell(F.col("name"), " colspan=2")).otherwise(cell(F.col("name")))
    coded = F.when(i.isin(1, 3), "").when(i == 2, cell(F.col("code"), ' rowspan="2" colspan="0"')).otherwise(cell(F.concat(F.lit("<b> "), "code", F.lit("</b>\n"))))
    row = F.struct("set_id", F.concat(F.lit("<tr>"), first, named, coded, cell(F.col("size").cast("string")), F.lit("</tr>")).alias("tr"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["tr"]), "")
    pages = d.product_sets(spark, sf_dir).groupBy(F.expr("set_id div 500").alias("page")).agg(F.concat(F.lit("<table><tbody>"), lines, F.lit("</tbody></table>")).alias("html"))
    grids = pages.select("page", F.explode(payloads.tables(F.col("html"))).alias("grid")).select("page", F.posexplode("grid").alias("line", "row"))
    return grids.select("page", F.col("line").cast("bigint").alias("line"), F.posexplode("row").alias("col", "cell")).withColumn("col", F.col("col").cast("bigint"))


_DRIFT = f"WITH g AS (SELECT set_id, set_id // 500 AS part, {_SHIFTED} AS day, set_id % 8 = 3 AS crawled, set_id % 1300 = 700 AS wrong FROM product_sets)"


def _drifted(spark, sf_dir):
    """Groups of payloads by ranges of sets; a few dates can't be read, and some are timestamps of a crawl."""
    said = F.when(F.expr("set_id % 1300 = 700"), F.lit("Q3 soon")).when(F.expr("set_id % 8 = 3"), F.lit("2023-01-01T20:00:07.1Z")).otherwise(F.concat(F.col("day").cast("string"), F.lit("T00:00:00")))
    return _sets(spark, sf_dir).select(F.expr(_PART), "fetched", F.lit("pokemon-tcg").alias("game"), F.col("set_id").alias("group_id"), "name", F.lit("").alias("code"), said.alias("published"), F.lit(False).alias("supplemental"))


@query("retail_failures", f"""{_DRIFT} SELECT part, 'pokemon-tcg.results.' || set_id || '.publishedOn' AS path, 'unparseable date "Q3 soon"' AS message FROM g WHERE wrong""")
def retail_failures(spark, sf_dir):
    return m.retail_failures(_drifted(spark, sf_dir), "part")


@query("retail_strict", f"{_DRIFT} SELECT set_id AS group_id, day FROM g WHERE NOT crawled AND day >= {_KEPT} AND part NOT IN (SELECT part FROM g WHERE wrong)", days=("day",))
def retail_strict(spark, sf_dir):
    """A payload with a date that can't be read gives nothing at all; the others give what they have."""
    return m.retail_groups(_drifted(spark, sf_dir), "fetched", payload="part").select("group_id", "day")


@query("page_map_tables", f"SELECT 'page' || install_id AS page, 'Set ' || set_id AS name, CASE WHEN set_id % 4 = 0 THEN 'TBD' ELSE 'EXACT' END AS kind, CASE WHEN set_id % 4 <> 0 THEN {_SHIFTED} END AS day FROM product_sets", days=("day",))
def page_map_tables(spark, sf_dir):
    """A payload is a map of page keys to pages; tables are found by their headers, banners and repeated headers left out."""
    row = F.concat(F.lit("<tr><td>Set "), "set_id", F.lit("</td><td>"), "code", F.lit("</td><td>"), F.when(F.expr("set_id % 4 = 0"), F.lit("TBA")).otherwise(F.col("said")), F.lit("</td></tr>"))
    head = "<tr><th>Name</th><th>Code</th><th>Release date</th></tr>"
    tables = _sets(spark, sf_dir).groupBy("install_id", F.expr(_PART)).agg(F.concat(F.lit(f"<table>{head}<tr><td colspan=3>Block</td></tr>"), F.array_join(F.collect_list(row), ""), F.lit(f"{head}</table>")).alias("html"))
    payload = tables.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("page"), "install_id"), "html")))).alias("body"))
    pages = payload.select(F.explode(F.from_json("body", "map<string,string>")).alias("page", "html"))
    rows = payloads.table_rows(pages, "html", ["set name", "name"], ["release date"])
    return rows.select("page", "name", "kind", F.col("date_exact").alias("day"))


@query("page_map_yield", "SELECT 'page' || install_id AS page, count(*) AS rows, count(*) FILTER (set_id % 4 <> 0) AS dated FROM product_sets WHERE install_id = 3 GROUP BY 1")
def page_map_yield(spark, sf_dir):
    """Pages with rows of which none has a date are drift to report: here page 3 alone, whose dates are taken away."""
    rows = page_map_tables(spark, sf_dir)
    drift = payloads.page_yield(rows.withColumn("kind", F.when(F.col("page") == "page3", "TBD").otherwise(F.col("kind"))), "page").select("page", "rows")
    return drift.join(rows.groupBy("page").agg(F.count_if(F.col("kind") != "TBD").alias("dated")), "page")


@query("html_product_blocks", f"SELECT 'x' || set_id AS slug, name || ' vol ' || size AS name, 'AB' || set_id AS code, 'EXACT' AS kind, {_SHIFTED} AS day FROM product_sets WHERE set_id % 5 <> 0 AND {_SHIFTED} >= {_KEPT}", days=("day",))
def html_product_blocks(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    code = F.concat(F.lit("[AB"), "set_id", F.lit("]"))
    in_title = F.when(F.expr("set_id % 5 <> 0 AND set_id % 2 = 0"), F.concat(F.lit(" "), code)).otherwise("")
    number = F.when(F.expr("set_id % 5 <> 0 AND set_id % 2 = 1"), F.concat(F.lit("<span class='number'>"), code, F.lit("</span>"))).otherwise("")
    block = F.concat(F.lit("<div class='item product'><a href='/products/x"), "set_id", F.lit(".html'><p class='title'>"), "name", F.lit("<br>vol "), "size", in_title, F.lit("</p>"), number, F.lit("<p class='date'>"), F.replace(F.col("said"), F.lit(", "), F.lit(",")), F.lit("</p></a></div>"))
    return m.product_blocks(_pages(sets.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))), block), "html", "fetched")


@query("html_labelled_rows", f"SELECT name, 'OP-' || set_id AS code, CASE WHEN set_id % 3 = 0 THEN 'WINDOW' ELSE 'EXACT' END AS kind, CASE WHEN set_id % 3 = 0 THEN 'MONTH' END AS granularity, CASE WHEN set_id % 3 = 0 THEN CAST(date_trunc('month', {_SHIFTED}) AS DATE) ELSE {_SHIFTED} END AS day FROM product_sets WHERE set_id % 4 <> 1 AND set_id % 7 <> 2 AND CASE WHEN set_id % 3 = 0 THEN CAST(date_trunc('month', {_SHIFTED}) AS DATE) ELSE {_SHIFTED} END >= {_KEPT}", days=("day",))
def html_labelled_rows(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    said = F.when(F.expr("set_id % 3 = 0"), F.date_format("day", "MMMM yyyy")).otherwise(F.col("said"))
    code = F.when(F.expr("set_id % 7 = 2"), F.lit("")).otherwise(F.concat(F.lit(" [OP-"), "set_id", F.lit("]")))
    label = F.when(F.expr("set_id % 4 = 1"), F.lit("On sale")).otherwise(F.lit("Release  Date"))
    row = F.concat(F.lit("<li class='row'><h4 class='name'>"), "name", code, F.lit("</h4><p><b class='head'>"), label, F.lit("</b><time datetime='"), F.col("day").cast("string"), F.lit("'>"), said, F.lit("</time></p></li>"))
    return m.labelled_rows(_pages(sets, row), "html", "fetched")


@query("html_articles", f"WITH a AS (SELECT *, CASE set_id % 3 WHEN 0 THEN 'pack' WHEN 1 THEN 'deck' ELSE 'goods' END AS genre, {_SHIFTED} AS day FROM product_sets) SELECT genre || '/bt' || set_id AS external_id, name, 'BT-' || set_id AS code, 'SHELF' AS type, day FROM a WHERE genre <> 'goods' AND day >= {_KEPT} UNION ALL SELECT genre || '/bt' || set_id, name, 'BT-' || set_id, 'PRERELEASE', day - 6 FROM a WHERE genre <> 'goods' AND set_id % 2 = 0 AND day - 6 >= {_KEPT}", days=("day",))
def html_articles(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    early = F.when(F.expr("set_id % 2 = 0"), F.concat(F.lit("<dl><dt>Pre-release date</dt><dd>"), F.date_format(F.date_sub("day", 6), "MMMM d, yyyy"), F.lit("</dd></dl>"))).otherwise("")
    article = F.concat(
        F.lit("<article data-url='/en/products/bt"), "set_id", F.lit(".php'><span class='genre genre-"), d.pick(F.col("set_id") % 3, "pack", "deck", "goods"), F.lit("'>G</span><h3 class='product-name'>Card Game<br>"), "name",
        F.lit(" [BT-"), "set_id", F.lit("]</h3>"), early, F.lit("<dl><dt>Release date</dt><dd>"), "said", F.lit("</dd></dl></article>"),
    )
    return m.article_rows(_pages(sets, article), "html", "fetched", "Card Game")


@query("index_and_details", f"SELECT 'boosters/ue' || set_id AS key, name, 'UE' || set_id || 'BT' AS code, 'EXACT' AS kind, {_SHIFTED} AS day FROM product_sets WHERE set_id % 4 <> 3 AND set_id % 6 <> 5", days=("day",))
def index_and_details(spark, sf_dir):
    """Rows of the index meet their detail pages by category and slug; the code stands in the page's heading."""
    sets = _sets(spark, sf_dir)
    tags = F.when(F.expr("set_id % 4 = 3"), F.lit("goods")).otherwise(F.lit("new, Boosters"))
    item = F.concat(F.lit("<li class='item' data-tags='"), tags, F.lit("'><a href='/en/boosters/ue"), "set_id", F.lit(".php'><p class='line'>Booster Pack</p><p class='line'>"), "name", F.lit("</p></a><p class='when'>"), "said", F.lit("</p></li>"))
    heading = F.concat(F.lit("<h1 id='top'><span>BOOSTER </span><p>"), "name", F.when(F.expr("set_id % 6 = 5"), F.lit("")).otherwise(F.concat(F.lit(" [UE"), "set_id", F.lit("BT]"))), F.lit("</p></h1>"))
    details = sets.select(m.path_key(F.concat(F.lit("https://example.org/en/boosters/ue"), "set_id", F.lit(".php?x=1"))).alias("key"), heading.alias("html"))
    return m.with_details(m.announced(_pages(sets, item), "html", ["boosters", "decks"]), details, "html")


@query("key_date_cells", f"SELECT set_id, label, CASE WHEN label = 'release' THEN {_SHIFTED} ELSE {_SHIFTED} - 8 END AS first_day, CASE WHEN label = 'release' THEN {_SHIFTED} ELSE {_SHIFTED} - 2 END AS last_day FROM product_sets, (VALUES ('release'), ('prerelease')) l(label)", days=("first_day", "last_day"))
def key_date_cells(spark, sf_dir):
    """Key-dates tables with ranges within and across months; a year stands in some cells only, and the page's own years tell the others."""
    rows = _sets(spark, sf_dir).withColumns({"a": F.date_sub("day", 8), "b": F.date_sub("day", 2)})
    words = lambda c: F.date_format(c, "MMMM d")
    within = F.date_format("a", "yyyyMM") == F.date_format("b", "yyyyMM")
    span = F.concat(words("a"), F.lit(" - "), F.when(within, F.dayofmonth("b").cast("string")).otherwise(words("b")))
    full = F.when(within | (F.year("a") == F.year("b")), F.concat(span, F.lit(", "), F.year("b").cast("string"))).otherwise(F.concat(words("a"), F.lit(", "), F.year("a").cast("string"), F.lit("–"), words("b"), F.lit(", "), F.year("b").cast("string")))
    cell = F.when((F.col("set_id") % 2 == 0) & ~(~within & (F.year("a") == F.year("b"))), full).otherwise(span)
    row = lambda label, value: F.concat(F.lit(f"<tr><th>{label}</th><td>"), value, F.lit("</td></tr>"))
    html = F.concat(F.lit("<h2>Scheduled Events</h2><p>Events "), F.year("a").cast("string"), F.lit(" and "), (F.year("a") + 1).cast("string"), F.lit("</p><h2>Key</h2><table class='x key-dates'>".replace("'", '"')), row("Prerelease (updated)", cell), row("Release", F.col("said")), row("Release", F.lit("never")), F.lit("</table>"))
    found = m.key_dates(rows.select("set_id", html.alias("html"), m.section_year(html, "Scheduled Events").alias("year")), "html")
    return m.spans(found, F.col("value"), F.col("year"), F.lit(None).cast("date")).select("set_id", "label", "first_day", "last_day")


@query("spans_after_a_floor", f"SELECT set_id, {_SHIFTED} + 3 AS first_day FROM product_sets", days=("first_day",))
def spans_after_a_floor(spark, sf_dir):
    """A day without a year is the first one after the floor, here the day that the page was published."""
    rows = _sets(spark, sf_dir)
    said = F.date_format(F.date_add("day", 3), "MMM. d")
    return m.spans(rows.select("set_id", F.replace(said, F.lit("May."), F.lit("May")).alias("said"), "day"), F.col("said"), F.lit(None).cast("int"), F.col("day")).select("set_id", "first_day")


@query("section_years", "SELECT set_id, CAST(CASE WHEN set_id % 3 = 0 THEN NULL ELSE 2020 + set_id % 9 END AS INTEGER) AS year FROM product_sets")
def section_years(spark, sf_dir):
    year = F.col("set_id") % 9 + 2020
    section = F.when(F.expr("set_id % 3 <> 0"), F.concat(F.lit("<p>from "), (year + 1).cast("string"), F.lit(" or <b>"), year.cast("string"), F.lit("</b> on, item 12345</p>"))).otherwise(F.lit("<p>none</p>"))
    html = F.concat(F.lit("<h2>Other 2001</h2><p>2002</p><h2 class=x>Scheduled Events today</h2>"), section, F.lit("<h2>Last</h2><p>2003</p>"))
    return d.product_sets(spark, sf_dir).select("set_id", m.section_year(html, "Scheduled Events").alias("year"))


@query("titles_trimmed", "SELECT set_id, name FROM product_sets")
def titles_trimmed(spark, sf_dir):
    title = F.concat(F.lit("Magic: The Gathering® | "), "name", F.lit("™ – Dates & Details | WPN"))
    return d.product_sets(spark, sf_dir).select("set_id", m.title_name(title).alias("name"))


@query("codes_clean", "SELECT set_id, CASE set_id % 6 WHEN 0 THEN 'OP-' || set_id WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'X' || set_id WHEN 4 THEN NULL ELSE 'AB' END AS code FROM product_sets")
def codes_clean(spark, sf_dir):
    n = F.col("set_id").cast("string")
    said = d.pick(F.col("set_id") % 6, "", "tba", "—", "", "a code of far too many signs", " ab ")
    cell = F.when(F.expr("set_id % 6 = 0"), F.concat(F.lit(" op-"), n)).when(F.expr("set_id % 6 = 3"), F.concat(F.lit("—  x"), n)).otherwise(said)
    return d.product_sets(spark, sf_dir).select("set_id", t.clean_code(cell).alias("code"))


@query("wiki_articles", "SELECT set_id, CASE WHEN set_id % 4 < 2 THEN name || '_(Set: é)' END AS article FROM product_sets")
def wiki_articles(spark, sf_dir):
    title = F.concat("name", F.lit("_(Set: é)"))
    href = F.when(F.expr("set_id % 4 = 0"), F.concat(F.lit("/wiki/"), F.replace(F.url_encode(title), F.lit("+"), F.lit("%20")))).when(F.expr("set_id % 4 = 1"), F.concat(F.lit("https://en.example.org/wiki/"), title)).when(F.expr("set_id % 4 = 2"), F.concat(F.lit("/wiki/File:"), title)).otherwise(F.concat(F.lit("/w/index.php?title="), title, F.lit("&redlink=1")))
    return d.product_sets(spark, sf_dir).select("set_id", t.article_id(href).alias("article"))


@query("articles_joined", "SELECT a.set_id, min(b.set_id) AS first_other FROM product_sets a JOIN product_sets b ON a.name = b.name AND a.install_id = 0 AND b.install_id = 1 GROUP BY a.set_id")
def articles_joined(spark, sf_dir):
    """Two pages' rows are one product if they link to one article."""
    rows = d.product_sets(spark, sf_dir)
    page = lambda n, prefix: rows.where(f"install_id = {n}").select("set_id", t.article_id(F.concat(F.lit(prefix), F.replace(F.col("name"), F.lit(" "), F.lit("_")))).alias("article"))
    other = page(1, "https://jp.example.org/wiki/").groupBy("article").agg(F.min("set_id").alias("first_other"))
    return page(0, "/wiki/").join(other, "article").select("set_id", "first_other")


@query("validators", "SELECT set_id, CASE WHEN set_id % 4 IN (1, 3) THEN 'W/\"' || set_id || '\"' END AS etag, CASE WHEN set_id % 4 >= 2 THEN 'day ' || set_id END AS modified FROM product_sets UNION ALL SELECT -1, '{no json', NULL")
def validators(spark, sf_dir):
    """Encoded and decoded again; a tag that only begins like JSON stays a tag."""
    rows = d.product_sets(spark, sf_dir).select("set_id", F.when(F.expr("set_id % 4 IN (1, 3)"), F.concat(F.lit('W/"'), "set_id", F.lit('"'))).alias("e"), F.when(F.expr("set_id % 4 >= 2"), F.concat(F.lit("day "), "set_id")).alias("m"))
    stored = rows.select("set_id", m.encode_validators(F.col("e"), F.col("m")).alias("stored")).unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("set_id"), F.lit("{no json").alias("stored")))
    etag, modified = m.decode_validators(F.col("stored"))
    return stored.select("set_id", etag.alias("etag"), modified.alias("modified"))


@query("payload_framing", "SELECT page_id AS provider, CASE WHEN page_id % 7 = 0 THEN 'FAILED' WHEN page_id % 3 = 0 THEN 'NOT_MODIFIED' ELSE 'OK' END AS status, CASE WHEN page_id % 7 = 0 OR page_id % 3 = 0 THEN 0 ELSE length(html) END AS chars, CASE WHEN page_id % 7 = 0 THEN CASE WHEN page_id % 3 = 0 THEN sha256(html) WHEN page_id % 3 = 1 THEN sha256('old') END ELSE sha256(html) END AS sha256 FROM pages")
def payload_framing(spark, sf_dir):
    """A third of the pages is unchanged, a third changed, a third new; every seventh fetch failed."""
    pages = d.read(spark, sf_dir, "pages").withColumn("provider", F.col("page_id"))
    failed = F.col("page_id") % 7 == 0
    fetched = pages.select("provider", F.when(~failed, F.col("html")).alias("body"), F.when(failed, F.lit("timeout")).alias("error"))
    known = pages.where("page_id % 3 < 2").select("provider", F.when(F.col("page_id") % 3 == 0, F.sha2("html", 256)).otherwise(F.sha2(F.lit("old"), 256)).alias("sha256"))
    return m.framed(fetched, known).select("provider", "status", F.length("body").cast("bigint").alias("chars"), "sha256")


@query("payloads_of_run", "SELECT provider, run_id, row_number() OVER (ORDER BY provider, run_id) AS place FROM provider_runs WHERE scan_id = 7 AND provider IN (1, 3, 5) AND status <> 'FAILED'")
def payloads_of_run(spark, sf_dir):
    """A run's payloads of some providers, in order of provider; an empty list of providers would take all."""
    from pyspark.sql import Window

    rows = d.provider_runs(spark, sf_dir).where("scan_id = 7 AND status <> 'FAILED'").where(F.col("provider").isin(1, 3, 5))
    return rows.select("provider", "run_id", F.row_number().over(Window.partitionBy("scan_id").orderBy("provider", "run_id")).cast("bigint").alias("place"))


@query("candidate_naming", "SELECT set_id, CASE set_id % 4 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN 'ME0' || set_id % 9 || ': ' || name ELSE name END AS name, CASE set_id % 4 WHEN 0 THEN 'ME0' || set_id % 9 WHEN 1 THEN 'me-0' || set_id % 9 WHEN 2 THEN 'DLR' ELSE NULL END AS code FROM product_sets")
def candidate_naming(spark, sf_dir):
    """A leading code moves to an empty code column, goes where the column says the same, and stays where it says something else."""
    lead = F.concat(F.lit("ME0"), F.col("set_id") % 9)
    said = F.when(F.expr("set_id % 4 = 3"), F.concat(F.lit(' "'), F.replace(F.col("name"), F.lit(" "), F.lit("_")), F.lit('"'))).otherwise(F.concat(lead, F.lit(": "), "name"))
    code = F.when(F.expr("set_id % 4 = 1"), F.concat(F.lit("me-0"), F.col("set_id") % 9)).when(F.expr("set_id % 4 = 2"), F.lit("DLR"))
    name, own = t.cleaned_naming(said, code)
    return d.product_sets(spark, sf_dir).select("set_id", name.alias("name"), own.alias("code"))


_REGISTRY = connector.Registry()
for _key, _origin, _games in (("example.com", "index", ("magic-the-gathering",)), ("example.net", "retail", ("yugioh-tcg", "pokemon-tcg")), ("example.org", "wiki", ("pokemon-tcg", "one-piece-tcg"))):
    _REGISTRY.register(connector.Provider(_key, _origin, "COMMUNITY", _games, connector.titles))


@query("providers_in_scope", f"SELECT {GAMES}[1 + install_id] AS game, provider FROM installs JOIN (VALUES ('example.com', 'magic-the-gathering'), ('example.net', 'yugioh-tcg'), ('example.net', 'pokemon-tcg'), ('example.org', 'pokemon-tcg'), ('example.org', 'one-piece-tcg')) v(provider, covers) ON covers = {GAMES}[1 + install_id] WHERE enabled")
def providers_in_scope(spark, sf_dir):
    """Which providers a run asks for each installed game."""
    games = d.installs(spark, sf_dir).where("enabled").select(d.pick(F.col("install_id"), *GAMES).alias("game"))
    return _REGISTRY.in_scope(games, "game").select("game", "provider")


_PROVIDER = r"array_to_string(list_reverse(list_reverse(string_split(regexp_extract(url, '^https?://([^/?#:]+)', 1), '.'))[1:2]), '.')"


@query("provider_payloads", f"SELECT page_id, {_PROVIDER} AS provider, sha256(html) AS sha256, length(html) AS chars FROM pages")
def provider_payloads(spark, sf_dir):
    """Stored pages through a data source of their own, unpacked again."""
    spark.dataSource.register(connector.StoredPages)
    rows = spark.read.format("stored_pages").option("path", f"{sf_dir}/pages.parquet").load()
    return payloads.unpacked(rows.select("page_id", "provider", "sha256", "body")).select("page_id", "provider", "sha256", F.length("text").cast("bigint").alias("chars"))


@query("provider_candidates", f"SELECT page_id, nullif(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '') AS name FROM pages WHERE {_PROVIDER} = 'example.net'")
def provider_candidates(spark, sf_dir):
    """One provider's pages, by its own parser."""
    return _REGISTRY.read(spark, "example.net", f"{sf_dir}/pages.parquet")
