"""From stored payloads to candidate rows: JSON indexes, publisher pages, index and detail pages, and the framing around them."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dates import day_of, parsed
from tidemark.functions.text import folded_space, last_segment
from tidemark.sources.payloads import streamed
from tidemark.schema import CARD_GENRES, CARD_POOL_GAMES, CARD_POOL_NAME, COMPANION_TYPES, FORWARD_WINDOW_DAYS, NUMBERED_SET, PARENTED_GAME, PARENTED_NAME


def in_window(day: Column, fetched: Column) -> Column:
    """Unknown days stay; known ones from the forward window's begin on."""
    return day.isNull() | (day >= F.date_sub(fetched, FORWARD_WINDOW_DAYS))


def _iso(text: Column) -> Column:
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def set_index(payloads: DataFrame, body: str, fetched: str) -> DataFrame:
    """An index of sets: digital sets and companions that ship inside other products are left out; the retailer's id comes along as a key."""
    schema = "data array<struct<id: string, code: string, name: string, released_at: string, set_type: string, digital: boolean, tcgplayer_id: bigint, icon_svg_uri: string>>"
    s = payloads.select(fetched, F.explode(F.from_json(body, schema)["data"]).alias("s")).select(fetched, "s.*").withColumn("day", _iso(F.col("released_at")))
    kept = s.where(~F.coalesce("digital", F.lit(False)) & ~F.coalesce(F.col("set_type").isin(*COMPANION_TYPES), F.lit(False)) & in_window(F.col("day"), F.col(fetched)))
    ids = F.map_concat(F.create_map(F.lit("index"), F.col("id")), F.when(F.col("tcgplayer_id").isNotNull(), F.create_map(F.lit("retail"), F.col("tcgplayer_id").cast("string"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>")))
    image = F.when(F.col("icon_svg_uri").isNotNull(), "SYMBOL")
    return kept.select(ids.alias("external_ids"), F.trim("name").alias("name"), F.nullif(F.upper(F.trim("code")), F.lit("")).alias("code"), "day", F.lit("SHELF").alias("type"), F.col("set_type").alias("product_kind"), F.col("icon_svg_uri").alias("image_url"), image.alias("image_kind"))


def set_array(payloads: DataFrame, body: str, fetched: str) -> DataFrame:
    """A plain array of sets. Codes repeat, so the id is code and name; rows without either are left out, rows without a date are not."""
    schema = "array<struct<set_name: string, set_code: string, num_of_cards: int, tcg_date: string, set_image: string>>"
    s = payloads.select(fetched, F.explode(F.from_json(body, schema)).alias("s")).select(fetched, "s.*")
    s = s.withColumns({"day": _iso(F.col("tcg_date")), "name": F.trim("set_name"), "code": F.trim("set_code")})
    kept = s.where((F.col("name") != "") & (F.col("code") != "") & in_window(F.col("day"), F.col(fetched)))
    return kept.select(F.concat_ws(":", "code", "name").alias("external_id"), "name", "code", "day", F.col("set_image").alias("image_url"), F.when(F.col("set_image").isNotNull(), "ART").alias("image_kind"))


def _retail_dates(groups: DataFrame, order: str) -> DataFrame:
    """The groups with said (the written date, a companion series' being its parent's, in the one game that has them; of equal parents the last in order) and day."""
    raw = groups.withColumns({"name": F.trim("name"), "published": F.nullif(F.trim("published"), F.lit("")), "code": F.nullif(F.trim("code"), F.lit(""))})
    dated = raw.where(F.col("game") == PARENTED_GAME).where(~F.coalesce("supplemental", F.lit(False)) & F.col("published").isNotNull() & ~F.col("published").endswith("Z"))
    parents = dated.groupBy("game", F.lower("name").alias("_parent")).agg(F.max_by("published", order).alias("_date"))
    parent = F.nullif(F.lower(F.trim(F.regexp_extract("name", PARENTED_NAME, 1))), F.lit(""))
    return raw.withColumn("_parent", parent).join(parents, ["game", "_parent"], "left").withColumn("said", F.coalesce("_date", "published")).withColumn("day", _iso(F.col("said")))


def retail_failures(groups: DataFrame, payload: str, order: str = "group_id") -> DataFrame:
    """payload, path, message: written dates that can't be read, which fail their payload whole: taken for unknown, they would blank real dates. Crawl timestamps are none."""
    wrong = _retail_dates(groups, order).where(F.col("said").isNotNull() & ~F.col("said").endswith("Z") & F.col("day").isNull())
    return wrong.select(payload, F.concat_ws(".", "game", F.lit("results"), F.col("group_id").cast("string"), F.lit("publishedOn")).alias("path"), F.format_string('unparseable date "%s"', "said").alias("message"))


def retail_groups(groups: DataFrame, fetched: str, order: str = "group_id", payload: str | None = None) -> DataFrame:
    """A retailer's groups (game, group_id, name, code, published, supplemental): crawl timestamps and pools of prerelease cards are no products, a companion series
    takes its parent's date, a numbered set is a prerelease with its shelf date a week later. With `payload`, the column that tells payloads apart, those that have a failure give nothing."""
    if payload:
        groups = groups.join(retail_failures(groups, payload, order).select(payload).distinct(), payload, "left_anti")
    rows = _retail_dates(groups, order)
    pool = F.col("game").isin(*CARD_POOL_GAMES) & F.col("name").rlike(CARD_POOL_NAME)
    kept = rows.where(~F.coalesce(F.col("said").endswith("Z"), F.lit(False)) & (F.col("name") != "") & ~pool & in_window(F.col("day"), F.col(fetched)))
    numbered = (F.col("game") == "disney-lorcana") & F.col("day").isNotNull() & F.coalesce(F.col("code").rlike(NUMBERED_SET), F.lit(False))
    shelf = F.struct(F.lit("SHELF").alias("type"), F.col("day").alias("on"))
    two = F.array(F.struct(F.lit("PRERELEASE").alias("type"), F.col("day").alias("on")), F.struct(F.lit("SHELF").alias("type"), F.date_add("day", 7).alias("on")))
    return kept.withColumn("x", F.explode(F.when(numbered, two).otherwise(F.array(shelf)))).select("game", "group_id", "name", "code", "x.type", F.col("x.on").alias("day"))


_VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "area", "base", "col", "embed", "source", "track"}


class _Blocks(HTMLParser):
    """Elements that match `block` (a tag, or a class with a dot), with their attributes, their first link, and the texts of the elements inside that match a field."""

    def __init__(self, block: str, fields: list[str]):
        super().__init__()
        self.block, self.fields, self.done, self.stack, self.depth, self.open = block, fields, [], [], 0, []

    @staticmethod
    def is_a(tag: str, classes: list[str], wanted: str) -> bool:
        return wanted[1:] in classes if wanted[0] == "." else tag == wanted

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        classes = attrs.get("class", "").split()
        if tag in _VOID:
            self.handle_data(" ")
            return
        self.stack.append(tag)
        if not self.depth and self.is_a(tag, classes, self.block):
            self.depth, self.now = len(self.stack), {"attrs": dict(attrs), "texts": {}}
        if self.depth:
            if tag == "a" and "href" in attrs:
                self.now["attrs"].setdefault("href", attrs["href"])
            for f in self.fields:
                if self.is_a(tag, classes, f):
                    text: list[str] = []
                    self.now["texts"].setdefault(f, []).append(text)
                    self.now["texts"].setdefault(f"{f}@class", []).append([attrs.get("class", "")])
                    self.open.append((len(self.stack), text))

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack.pop() != tag:
            pass
        self.open = [(d, t) for d, t in self.open if d <= len(self.stack)]
        if self.depth > len(self.stack):
            self.now["texts"] = {k: [" ".join("".join(t).split()) for t in v] for k, v in self.now["texts"].items()}
            self.done.append(self.now)
            self.depth = 0

    def handle_data(self, data):
        for _, text in self.open:
            text.append(data)


_BLOCK = "struct<attrs: map<string, string>, texts: map<string, array<string>>>"


def blocks(pages: DataFrame, html: str, block: str, fields: list[str]) -> DataFrame:
    """The pages' other columns and `b`, a struct of attrs and texts, for each block of a page. Spark has no HTML parser."""

    def found(page: str | None) -> list[dict]:
        parser = _Blocks(block, fields)
        parser.feed(page or "")
        for tag in reversed(list(parser.stack)):
            parser.handle_endtag(tag)
        return [{k: list(v.items()) for k, v in b.items()} for b in parser.done]

    return streamed(pages, html, "b", _BLOCK, found, many=True)


def _text(field: str) -> Column:
    return F.try_element_at(F.try_element_at(F.col("b.texts"), F.lit(field)), F.lit(1))


BRACKETED = r"\[([^\]]{1,16})\]\s*$"


def product_blocks(pages: DataFrame, html: str, fetched: str) -> DataFrame:
    """Product blocks with title, date and perhaps a number of their own. What has no code is an accessory; a block that a carousel repeats counts once."""
    rows = blocks(pages.select(fetched, html), html, ".product", [".title", ".date", ".number"])
    number = F.nullif(F.regexp_extract(_text(".number"), r"\[([^\]]{1,16})\]", 1), F.lit(""))
    title = _text(".title")
    rows = rows.withColumns({"title": title, "code": F.trim(F.coalesce(number, F.nullif(F.regexp_extract(title, BRACKETED, 1), F.lit("")))), "said": F.regexp_replace(_text(".date"), r",(\S)", ", $1"), "slug": last_segment(F.concat(F.lit("https://x"), F.col("b.attrs")["href"]))})
    named = rows.where("code IS NOT NULL AND title <> ''").withColumn("name", F.when(number.isNotNull(), F.col("title")).otherwise(F.trim(F.regexp_replace("title", BRACKETED, ""))))
    dated = parsed(named, F.col("said")).where("kind <> 'TBD'").withColumn("day", F.coalesce("date_exact", "window_start"))
    return dated.where(in_window(F.col("day"), F.col(fetched))).select("slug", "name", "code", "kind", "day").distinct()


def labelled_rows(pages: DataFrame, html: str, fetched: str) -> DataFrame:
    """Rows whose date has the label of a release. The written text counts, not a machine-readable attribute, which would make a month a day."""
    rows = blocks(pages.select(fetched, html), html, ".row", [".name", ".head", "time"])
    rows = rows.where((F.lower(_text(".head")) == "release date") & _text("time").isNotNull()).select(fetched, _text(".name").alias("title"), _text("time").alias("said"))
    rows = rows.withColumn("code", F.trim(F.nullif(F.regexp_extract("title", BRACKETED, 1), F.lit("")))).where("code IS NOT NULL").withColumn("name", F.trim(F.regexp_replace("title", BRACKETED, "")))
    dated = parsed(rows, F.col("said")).where("kind <> 'TBD'").withColumn("day", F.coalesce("date_exact", "window_start"))
    return dated.where(in_window(F.col("day"), F.col(fetched))).select("name", "code", "kind", "granularity", "day")


def article_rows(pages: DataFrame, html: str, fetched: str, prefix: str) -> DataFrame:
    """Articles of card genres with a release date and perhaps a prerelease date: a row for each known day."""
    rows = blocks(pages.select(fetched, html), html, "article", [".genre", ".product-name", "dt", "dd"])
    genre = F.regexp_extract(_text(".genre@class"), r"genre-(\w+)", 1)
    labels = F.transform(F.coalesce(F.col("b.texts")["dt"], F.array()), lambda x: F.lower(x))
    value = lambda pattern: F.try_element_at(F.transform(F.filter(F.arrays_zip(labels.alias("dt"), F.coalesce(F.col("b.texts")["dd"], F.array()).alias("dd")), lambda p: p["dt"].rlike(pattern)), lambda p: p["dd"]), F.lit(1))
    rows = rows.where(genre.isin(*CARD_GENRES)).select(fetched, F.concat_ws("/", genre, last_segment(F.concat(F.lit("https://x"), F.col("b.attrs")["data-url"]))).alias("external_id"), _text(".product-name").alias("title"), value("^release date").alias("shelf"), value("^pre-?release date").alias("early"))
    rows = rows.withColumn("code", F.nullif(F.regexp_extract("title", BRACKETED, 1), F.lit(""))).where("code IS NOT NULL AND shelf IS NOT NULL")
    rows = rows.withColumn("name", F.trim(F.regexp_replace(F.regexp_replace("title", BRACKETED, ""), rf"(?i)^{re.escape(prefix)}\s+", "")))
    both = rows.withColumn("x", F.explode(F.array(F.struct(F.lit("SHELF").alias("type"), F.col("shelf").alias("said")), F.struct(F.lit("PRERELEASE").alias("type"), F.col("early").alias("said")))))
    dated = parsed(both.select(fetched, "external_id", "name", "code", "x.type", "x.said"), F.col("said")).withColumn("day", F.coalesce("date_exact", "window_start"))
    return dated.where(F.col("day").isNotNull() & in_window(F.col("day"), F.col(fetched))).select("external_id", "name", "code", "type", "day")


def path_key(href: Column) -> Column:
    """Category and slug of a link: its last two segments, without extension."""
    path = F.regexp_replace(F.regexp_replace(href, r"^https?://[^/?#]+", ""), r"[?#].*$", "")
    pair = F.regexp_extract(path, r"([^/]+/[^/]+?)(?:\.[A-Za-z0-9]+)?/*$", 1)
    return F.nullif(pair, F.lit(""))


def announced(index: DataFrame, html: str, tags: list[str]) -> DataFrame:
    """Rows of an index page with one of the tags: key of the detail page, the second line of the title if there are two, and the date's text."""
    rows = blocks(index.select(html), html, ".item", [".line", ".when"])
    own = F.transform(F.split(F.coalesce(F.col("b.attrs")["data-tags"], F.lit("")), ","), lambda t: F.lower(F.trim(t)))
    lines = F.filter(F.coalesce(F.col("b.texts")[".line"], F.array()), lambda x: x != "")
    name = F.coalesce(F.try_element_at(lines, F.lit(2)), F.try_element_at(lines, F.lit(1)))
    return rows.where(F.arrays_overlap(own, F.array(*[F.lit(t) for t in tags]))).select(path_key(F.col("b.attrs")["href"]).alias("key"), name.alias("name"), _text(".when").alias("said")).where("key IS NOT NULL AND name IS NOT NULL")


def with_details(items: DataFrame, details: DataFrame, html: str) -> DataFrame:
    """Index rows joined with their detail page by key; the page's heading ends in the code, and a row without page or code is left out."""
    heading = F.concat_ws(" ", F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)))
    code = F.nullif(F.regexp_extract(folded_space(F.regexp_replace(heading, "<[^>]*>", " ")), r"\[([A-Z0-9-]{3,12})\]\s*$", 1), F.lit(""))
    met = items.join(details.select("key", code.alias("code")).where("code IS NOT NULL"), "key")
    return parsed(met, F.col("said")).where("kind <> 'TBD'").select("key", "name", "code", "kind", F.coalesce("date_exact", "window_start").alias("day"))


def key_dates(pages: DataFrame, html: str) -> DataFrame:
    """Label and value of the rows of a key-dates table; notes in brackets after a label are dropped, of equal labels the first row counts."""
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: folded_space(F.regexp_replace(c, "<[^>]*>", " ")))
    table = F.regexp_extract(html, r'(?is)<table[^>]*class="[^"]*\bkey-dates\b[^"]*"[^>]*>(.*?)</table>', 1)
    rows = pages.select("*", F.posexplode(F.regexp_extract_all(table, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("_n", "_r")).withColumn("_c", cells(F.col("_r"))).where("size(_c) >= 2")
    label = F.lower(F.trim(F.regexp_replace(F.col("_c")[0], r"\s*\([^)]*\)\s*$", "")))
    named = rows.withColumns({"label": label, "value": F.col("_c")[1]}).where("label <> ''")
    keys = [c for c in pages.columns if c != html]
    return named.groupBy(*keys, "label").agg(F.min_by("value", "_n").alias("value"))


def section_year(html: Column, heading: str) -> Column:
    """The earliest year from 2000 on in the section under a heading."""
    section = F.regexp_extract(html, rf"(?is)<h2[^>]*>\s*{re.escape(heading)}\b.*?</h2>(.*?)(?:<h2\b|$)", 1)
    return F.array_min(F.transform(F.regexp_extract_all(F.regexp_replace(section, "<[^>]*>", " "), F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))


def title_name(title: Column) -> Column:
    """A page title without marks, the site's name, the words of a dates page and the game's name before it."""
    out = F.regexp_replace(title, "[®™]", "")
    for pattern in (r"(?i)\s*\|\s*WPN\s*$", r"(?i)\s*[–—-]\s*Dates\s*&\s*Details\s*$", r"(?i)^\s*Magic:\s*The\s+Gathering\s*\|\s*"):
        out = F.regexp_replace(out, pattern, "")
    return folded_space(out)


def encode_validators(etag: Column, modified: Column) -> Column:
    """A lone entity tag as it is, else JSON of both; null without either."""
    return F.when(etag.isNull() & modified.isNull(), None).when(modified.isNull(), etag).otherwise(F.to_json(F.struct(etag.alias("etag"), modified.alias("lastModified")), {"ignoreNullFields": "false"}))


def decode_validators(stored: Column) -> tuple[Column, Column]:
    """Entity tag and modification time; what begins like JSON but is none is an entity tag."""
    is_json = stored.startswith("{") & F.try_parse_json(stored).isNotNull()
    part = lambda k: F.get_json_object(stored, f"$.{k}")
    return F.when(is_json, part("etag")).otherwise(stored), F.when(is_json, part("lastModified"))


def framed(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Payload records of fetches (provider, body, error) against the last known hashes (provider, sha256): FAILED keeps an empty body, equal content is NOT_MODIFIED with
    an empty body, and the hash is carried forward."""
    rows = fetched.join(known.select("provider", F.col("sha256").alias("_known")), "provider", "left").withColumn("sha256", F.sha2("body", 256))
    same = F.col("sha256") == F.col("_known")
    status = F.when(F.col("error").isNotNull(), "FAILED").when(F.coalesce(same, F.lit(False)), "NOT_MODIFIED").otherwise("OK")
    return rows.select("provider", status.alias("status"), F.when(status == "OK", F.col("body")).otherwise("").alias("body"), F.when(status == "FAILED", F.col("_known")).otherwise(F.col("sha256")).alias("sha256"), "error")


def spans(rows: DataFrame, text: Column, hint: Column, floor: Column) -> DataFrame:
    """rows with first_day and last_day of a cell such as `June 5`, `June 5-9`, `December 29 - January 4, 2027`. Without a year the hint's or the floor's counts, and a day on or
    before the floor is next year's; a range that seems to run backwards ends in the next year. Null where nothing can be told."""
    said = F.regexp_replace(folded_space(text), r"\s*[-–—]\s*", "-")
    name = r"([A-Za-z]+)\.? (\d{1,2})(?:, (\d{4}))?"
    cross, same, single = rf"^{name}-{name}$", r"^([A-Za-z]+)\.? (\d{1,2})-(\d{1,2})(?:, (\d{4}))?$", rf"^{name}$"
    part = lambda pattern, k: F.nullif(F.regexp_extract("_said", pattern, k), F.lit(""))
    kind = F.when(F.col("_said").rlike(cross), "cross").when(F.col("_said").rlike(same), "same").when(F.col("_said").rlike(single), "single")
    rows = rows.withColumns({"_said": said, "_hint": hint, "_floor": floor}).withColumn("_kind", kind)
    pick = lambda c, s, o: F.when(F.col("_kind") == "cross", part(cross, c) if c else None).when(F.col("_kind") == "same", part(same, s) if s else None).otherwise(part(single, o) if o else None)
    rows = rows.withColumns({"_m": pick(1, 1, 1), "_d": pick(2, 2, 2), "_y": pick(3, 4, 3), "_m2": pick(4, 1, 0), "_d2": pick(5, 3, 0), "_y2": pick(6, 0, 0)})
    year = F.coalesce(F.col("_hint"), F.year("_floor"))
    guess = day_of(year.cast("string"), F.col("_m"), F.col("_d"))
    later = F.when(guess <= F.col("_floor"), day_of((year + 1).cast("string"), F.col("_m"), F.col("_d"))).otherwise(guess)
    rows = rows.withColumn("first_day", F.when(F.col("_y").isNotNull(), day_of(F.col("_y"), F.col("_m"), F.col("_d"))).otherwise(later))
    own = F.year("first_day")
    end = day_of(F.coalesce(F.col("_y2"), own.cast("string")), F.col("_m2"), F.col("_d2"))
    end = F.when((F.col("_kind") == "cross") & F.col("_y2").isNull() & (end < F.col("first_day")), day_of((own + 1).cast("string"), F.col("_m2"), F.col("_d2"))).otherwise(end)
    rows = rows.withColumn("last_day", F.when(F.col("_kind") == "single", F.col("first_day")).otherwise(end))
    good = F.col("first_day").isNotNull() & F.col("last_day").isNotNull() & ((F.col("_kind") != "same") | (F.col("last_day") >= F.col("first_day")))
    out = {c: F.when(good, F.col(c)) for c in ("first_day", "last_day")}
    return rows.withColumns(out).drop("_said", "_hint", "_floor", "_kind", "_m", "_d", "_y", "_m2", "_d2", "_y2")
