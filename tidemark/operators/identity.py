"""Identity of products: by external id, by code, by name, else new.

All tiers are joins. Names meet by equal forms (whole, without code tokens, or the part after a separator where one side leads with a code), or by the Dice
coefficient of their words, for which names meet in their rarest words alone. `resolve` looks at what is stored alone; `resolve_in_order` takes candidates one after the other, each with
the sets and ids that those before it left behind: joins find all that can match, a fold in order decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import code_in_name, is_placeholder, normal_code, normal_name, numbers, sequence_number, tokens, without_codes, without_trailing_code
from tidemark.operators.graph import linked
from tidemark.operators.snapshots import settled
from tidemark.schema import CODED_HEAD, MIN_NAME, SIMILARITY_AT, TAIL


def similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of two names' significant words. Different numbers, or different labels of a sequence, give 0; equal
    words after a trailing code is gone give 1."""
    ta, tb = tokens(a), tokens(b)
    sa, sb = sequence_number(a), sequence_number(b)
    veto = (F.array_sort(numbers(a)) != F.array_sort(numbers(b))) | F.coalesce(sa != sb, F.lit(False))
    ca, cb = tokens(without_trailing_code(a)), tokens(without_trailing_code(b))
    same = (F.size(ca) > 0) & (F.array_sort(ca) == F.array_sort(cb))
    dice = 2.0 * F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(ta) + F.size(tb), F.lit(1))
    return F.when(veto, 0.0).when(same, 1.0).otherwise(dice)


def code_key(name: Column, code: Column, synthetic: Column | None = None) -> Column:
    """The normal code: of the code column, which then is all that counts, else of the name. A made-up code is none."""
    own = normal_code(code) if synthetic is None else F.when(~synthetic, normal_code(code))
    return F.coalesce(own, code_in_name(name))


def ambiguous_codes(candidates: DataFrame) -> DataFrame:
    """game, origin, key: codes that one origin gives to several products of a game, and which so are no key in that game."""
    rows = candidates.select("game", "origin", code_key(F.col("name"), F.col("code")).alias("key"), normal_name(F.col("name")).alias("n")).where("key IS NOT NULL")
    return rows.groupBy("game", "origin", "key").agg(F.countDistinct("n").alias("names")).where("names > 1").select("game", "origin", "key")


def by_id(candidates: DataFrame, identities: DataFrame) -> DataFrame:
    """candidate_id, set_id: the own origin's id first, then foreign ones in order of origin."""
    ids = candidates.select("candidate_id", F.col("origin").alias("own"), F.explode("external_ids").alias("origin", "external_id"))
    found = ids.join(identities, ["origin", "external_id"])
    order = Window.partitionBy("candidate_id").orderBy((F.col("own") != F.col("origin")).cast("int"), "origin")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("candidate_id", "set_id", F.col("origin").alias("matched_origin"))


def by_code(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """candidate_id, set_id where exactly one set of the game has the candidate's code, and the code is no ambiguous one. A set with a made-up code has the one in its name."""
    wanted = candidates.select("candidate_id", "game", "origin", code_key(F.col("name"), F.col("code")).alias("key")).where("key IS NOT NULL")
    clear = wanted.join(ambiguous_codes(candidates).select("game", "key").distinct(), ["game", "key"], "left_anti")
    known = sets.select("game", "set_id", code_key(F.col("name"), F.col("code"), F.col("synthetic")).alias("key")).where("key IS NOT NULL")
    single = known.groupBy("game", "key").agg(F.min("set_id").alias("set_id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return clear.join(single, ["game", "key"]).select("candidate_id", "set_id")


def _features(names: DataFrame) -> DataFrame:
    """game, name and what its comparison needs, taken from the name once: words, numbers, place in a sequence, words without a trailing code, numbers without codes."""
    name = F.col("name")
    of = {"words": tokens(name), "numbers": F.array_sort(numbers(name)), "sequence": sequence_number(name), "plain": F.array_sort(tokens(without_trailing_code(name))), "bare_numbers": F.array_sort(numbers(without_codes(name)))}
    return names.select("game", "name", name.rlike(CODED_HEAD).alias("coded"), *[c.alias(k) for k, c in of.items()])


def _forms(names: DataFrame) -> DataFrame:
    """The names with their features, key, tail: the forms under which a name may equal another."""
    name = F.col("name")
    whole = F.array(*[F.struct(k.alias("key"), F.lit(False).alias("tail")) for k in (normal_name(name), normal_name(without_codes(name)), F.concat(F.lit("="), F.array_join("plain", " ")))])
    tail = F.array(F.struct(normal_name(F.regexp_extract(name, TAIL, 1)).alias("key"), F.lit(True).alias("tail")))
    rows = names.select("game", "name", "coded", "sequence", "bare_numbers", F.explode(F.array_distinct(F.concat(whole, tail))).alias("f"))
    return rows.select("game", "name", "coded", "sequence", "bare_numbers", "f.key", "f.tail").where(F.length("key") >= MIN_NAME)


def _scored(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (game, x, y) whose names' words are alike enough, by the features of their names; `similarity` says the same of two columns."""
    side = lambda name, c: known.select("game", F.col("name").alias(name), F.struct("words", "numbers", "sequence", "plain").alias(c))
    both = pairs.join(side("x", "a"), ["game", "x"]).join(side("y", "b"), ["game", "y"])
    veto = (F.col("a.numbers") != F.col("b.numbers")) | F.coalesce(F.col("a.sequence") != F.col("b.sequence"), F.lit(False))
    same = (F.size("a.plain") > 0) & (F.col("a.plain") == F.col("b.plain"))
    shared = 2.0 * F.size(F.array_intersect("a.words", "b.words")) / F.greatest(F.size("a.words") + F.size("b.words"), F.lit(1))
    score = F.when(veto, 0.0).when(same, 1.0).otherwise(shared)
    return both.select("game", "x", "y", score.alias("score")).where(F.col("score") >= SIMILARITY_AT)


def name_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """game, x, y, score for the names (game, name) of either side that match, SIMILARITY_AT or better.

    Words are ordered by how few names have them. Names of Dice 0.75 or more share at least 0.6 of either one's words, so one of the first n - 0.6 n + 1 words of each is the same.
    """
    known = settled(_features(left.unionByName(right).distinct()))
    left, right = known.join(left, ["game", "name"], "left_semi"), known.join(right, ["game", "name"], "left_semi")
    a, b = _forms(left).alias("a"), _forms(right).alias("b")
    may = (~F.col("a.tail") & ~F.col("b.tail")) | F.col("a.coded") | F.col("b.coded")
    veto = F.coalesce(F.col("a.sequence") != F.col("b.sequence"), F.lit(False)) | (F.col("a.bare_numbers") != F.col("b.bare_numbers"))
    exact = a.join(b, F.expr("a.game = b.game AND a.key = b.key")).where(may & (~veto | F.col("a.tail") | F.col("b.tail"))).select("a.game", F.col("a.name").alias("x"), F.col("b.name").alias("y"), F.lit(1.0).alias("score"))
    counts = known.select("game", F.explode("words").alias("w")).groupBy("game", "w").agg(F.count(F.lit(1)).alias("df"))
    share = SIMILARITY_AT / (2 - SIMILARITY_AT)

    def prefixes(df: DataFrame) -> DataFrame:
        each = df.select("game", "name", F.size("words").alias("n"), F.explode("words").alias("w")).join(counts, ["game", "w"])
        place = F.row_number().over(Window.partitionBy("game", "name").orderBy("df", "w"))
        return each.withColumn("k", place).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)) + 1).select("game", "name", "n", "w")

    # few bytes make many pairs: the number of partitions is fixed, so that Spark doesn't put them together by their size
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p, q = prefixes(left).repartition(parts, "game", "w").alias("p"), prefixes(right).alias("q")
    lengths = (F.col("p.n") >= F.col("q.n") * F.lit(share - 1e-9)) & (F.col("q.n") >= F.col("p.n") * F.lit(share - 1e-9))
    met = p.join(q, F.expr("p.game = q.game AND p.w = q.w")).where(lengths).select("p.game", F.col("p.name").alias("x"), F.col("q.name").alias("y")).repartition(parts, "game", "x", "y").distinct()
    return _scored(met, known).unionByName(exact).groupBy("game", "x", "y").agg(F.max("score").alias("score"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.where(~is_placeholder(F.col("name")) & (F.length(normal_name(F.col("name"))) >= MIN_NAME))


def by_name(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """candidate_id, set_id, score: the best name of the game, the oldest of equals. Placeholders match nothing; both having
    codes that differ is a veto."""
    a = _named(candidates).withColumn("c", code_key(F.col("name"), F.col("code")))
    b = _named(sets).withColumn("c", code_key(F.col("name"), F.col("code"), F.col("synthetic"))).groupBy("game", "name", "c").agg(F.min(F.struct("created", "set_id")).alias("first"))
    # Names repeat: each pair of different spellings is scored once, then candidates and sets join it.
    scored = name_pairs(a.select("game", "name").distinct(), b.select("game", "name").distinct())
    # So do candidates' names with their codes: the best set is found once for each such class, and candidates join that.
    classes = a.select("game", "name", "c").distinct().alias("a")
    met = classes.join(scored.alias("s"), F.expr("a.game = s.game AND a.name = s.x")).join(b.alias("b"), F.expr("s.game = b.game AND s.y = b.name"))
    no_veto = F.col("a.c").isNull() | F.col("b.c").isNull() | (F.col("a.c") == F.col("b.c"))
    best = met.where(no_veto).groupBy("a.game", "a.name", "a.c").agg(F.min(F.struct(-F.col("s.score"), "b.first")).alias("m"))
    # short rows: the number of partitions is fixed, so that Spark doesn't put them together by their size
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = a.select("candidate_id", "game", "name", "c").alias("a").join(best.alias("m"), F.expr("a.game = m.game AND a.name = m.name AND a.c <=> m.c"))
    own = rows.select("candidate_id", "m.m").repartition(parts, "candidate_id").groupBy("candidate_id").agg(F.min("m").alias("m"))
    return own.select("candidate_id", F.col("m.first.set_id").alias("set_id"), (-F.col("m")["col1"]).alias("score"))


def resolve(candidates: DataFrame, sets: DataFrame, identities: DataFrame) -> DataFrame:
    """The candidates with set_id and matched_by (id, code, name or new). New products have a set of their own here."""
    ids = by_id(candidates, identities).select("candidate_id", F.col("set_id").alias("s1"))
    codes = by_code(candidates, sets).select("candidate_id", F.col("set_id").alias("s2"))
    names = by_name(candidates, sets).select("candidate_id", F.col("set_id").alias("s3"))
    rows = candidates.join(ids, "candidate_id", "left").join(codes, "candidate_id", "left").join(names, "candidate_id", "left")
    by = F.when(F.col("s1").isNotNull(), "id").when(F.col("s2").isNotNull(), "code").when(F.col("s3").isNotNull(), "name").otherwise("new")
    fresh = F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("|", "game", "candidate_id"), 256), 1, 12))
    return rows.select(*candidates.columns, F.coalesce("s1", "s2", "s3", fresh).alias("set_id"), by.alias("matched_by"))


#: Parts of so many rows at most are folded by game; a larger game is first split into groups that share no id, code or name.
WHOLE_GAME = 200_000

_FOLDED = "part string, kind int, place bigint, id string, game string, name string, other string, score double, key string, name_key string, code string, clear boolean, real boolean, ids array<struct<key:string,set_id:string>>"


class _Part:
    """What a part's candidates have met so far: names that match, sets by code and name in the order of their age, and ids."""

    def __init__(self) -> None:
        self.matching: dict[str, list[tuple[float, str]]] = {}
        self.by_code: dict[tuple, set[str]] = {}
        self.by_name: dict[tuple, dict[str | None, tuple[int, str]]] = {}
        self.codes: set[tuple] = set()
        self.pins: dict[tuple, str] = {}
        self.made = 0

    def add(self, game: str, name: str | None, key: str | None, code: str | None, set_id: str) -> None:
        self.made += 1
        self.codes.add((game, code))
        if key is not None:
            self.by_code.setdefault((game, key), set()).add(set_id)
        if name is not None:
            self.by_name.setdefault((game, name), {}).setdefault(key, (self.made, set_id))

    def named(self, game: str, name: str | None, key: str | None) -> str | None:
        best = None
        for score, other in self.matching.get((game, name), ()):
            sets = self.by_name.get((game, other), {})
            for k in sets if key is None else (key, None):
                if k in sets and (best is None or (-score, *sets[k]) < best):
                    best = (-score, *sets[k])
        return best and best[2]

    def take(self, row: dict) -> tuple[str, str]:
        game, key = row["game"], row["key"]
        held = [i["set_id"] or self.pins.get((game, i["key"])) for i in row["ids"]]
        by, found = "id", next((s for s in held if s), None)
        if not found and row["clear"] and len(owners := self.by_code.get((game, key), ())) == 1:
            by, found = "code", next(iter(owners))
        if not found and row["name"] is not None:
            by, found = "name", self.named(game, row["name"], key)
        if not found:
            by, found = "new", "new-" + hashlib.sha256(f"{game}|{row['id']}".encode()).hexdigest()[:12]
            own = row["real"] and (game, row["code"]) not in self.codes
            self.add(game, row["name"], key if own else row["name_key"], row["code"] if own else None, found)
        for i, s in zip(row["ids"], held, strict=True):
            if not s:
                self.pins[game, i["key"]] = found
        return found, by


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part, in it names that match, then sets by age, then candidates in order. What is held is a part's sets, ids and names, not its candidates."""
    part, state = None, _Part()
    for batch in batches:
        out: list[tuple[str, str, str]] = []
        for row in batch.to_pylist():
            if row["part"] != part:
                part, state = row["part"], _Part()
            if row["kind"] == 0:
                state.matching.setdefault((row["game"], row["name"]), []).append((row["score"], row["other"]))
            elif row["kind"] == 1:
                state.add(row["game"], row["name"], row["key"], row["code"], row["id"])
            else:
                out.append((row["id"], *state.take(row)))
        yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in out], pa.string()) for k, c in enumerate(("candidate_id", "set_id", "matched_by"))})


def _parted(rows: DataFrame, whole_game: int) -> DataFrame:
    """The rows with their part: the game, or in games of more rows the group that shares ids, codes and matching names."""
    large = rows.groupBy("game").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole_game).select("game")
    if large.isEmpty():
        return rows.withColumn("part", F.col("game"))
    rows = rows.withColumn("node", F.when(F.col("kind") == 0, F.concat_ws("|", F.lit("n"), "game", "name")).otherwise(F.concat_ws("|", F.col("kind").cast("string"), "game", "id")))
    keys = F.concat(
        F.transform("ids", lambda i: F.concat(F.lit("i|"), i["key"])),
        F.transform("ids", lambda i: F.concat(F.lit("s|"), i["set_id"])),
        F.array(F.concat(F.lit("c|"), "key"), F.concat(F.lit("c|"), "name_key"), F.concat(F.lit("l|"), "code"), F.concat(F.lit("n|"), "name"), F.concat(F.lit("n|"), "other"), F.when(F.col("kind") == 1, F.concat(F.lit("s|"), "id"))),
    )
    members = rows.join(large, "game", "left_semi").select("node", F.explode(F.array_append(F.filter(keys, lambda k: k.isNotNull()), F.concat(F.lit("="), "node"))).alias("key"), "game")
    labels = linked(members.select("node", F.concat_ws("|", "game", "key").alias("key")))
    return rows.join(labels, "node", "left").withColumn("part", F.coalesce("label", "game")).drop("node", "label")


def _representatives(known: DataFrame) -> DataFrame:
    """Of stored sets that are equal in game, name, key and code the oldest, and one other: a code counts if it has one owner, and a name leads to its oldest set, so more of them change nothing."""
    alike = known.groupBy("kind", "game", "name", "key", "code").agg(F.min(F.struct("place", "id")).alias("first"), F.max("place").alias("last"), F.min("id").alias("low"), F.max("id").alias("high"))
    other = F.when(F.col("low") != F.col("high"), F.struct(F.col("last").alias("place"), F.when(F.col("high") != F.col("first.id"), F.col("high")).otherwise(F.col("low")).alias("id")))
    both = alike.select("kind", "game", "name", "key", "code", F.explode(F.filter(F.array("first", other), lambda r: r.isNotNull())).alias("r"))
    return both.select("kind", "r.place", "r.id", "game", "name", "key", "code")


def resolve_in_order(candidates: DataFrame, sets: DataFrame, identities: DataFrame, whole_game: int = WHOLE_GAME) -> DataFrame:
    """The candidates with set_id and matched_by (id, code, name or new), each resolved in the order of candidate_id against what is stored and what those before it left behind.

    A new product makes a set, which later ones find by its code or name. Every candidate pins its ids to the set it went to, whatever matched, unless they are pinned already; so an id that came with a
    follower leads to the leader's set. Ids hold within a game. A set keeps its maker's code if that is real, not ambiguous and not taken, else it has a made-up one and the code in its name.

    The order matters, so a part is folded by one task, which streams its candidates. Those that repeat game, origin and ids are resolved by id after the first, which alone is folded, and of equal stored sets two are. Stored ids
    and matching names are found by joins before.
    """
    key, n = code_key(F.col("name"), F.col("code")), F.col("name")
    matchable = F.when(~is_placeholder(n) & (F.length(normal_name(n)) >= MIN_NAME), n)
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce("external_ids", F.create_map().cast("map<string,string>"))), lambda e: F.struct((e["key"] != F.col("origin")).alias("foreign"), e["key"].alias("origin"), e["value"].alias("value"))))
    rows = candidates.select("candidate_id", "game", "origin", n, "code", key.alias("key"), normal_code("code").alias("own"), entries.alias("ids"))
    rows = rows.withColumn("class", F.when(F.size("ids") > 0, F.to_json("ids")).otherwise(F.concat(F.lit("#"), "candidate_id")))
    first = rows.groupBy("game", "origin", "class").agg(F.min_by(F.struct("candidate_id", "name", "code", "key", "own", "ids"), "candidate_id").alias("r")).select("game", "origin", "class", "r.*")

    many = ambiguous_codes(candidates).select("game", "key").distinct()
    clear = first.join(many.withColumn("many", F.lit(True)), ["game", "key"], "left").join(many.select("game", F.col("key").alias("own"), F.lit(True).alias("own_many")), ["game", "own"], "left")
    stored = identities.join(sets.select("set_id", "game"), "set_id").groupBy("game", "origin", F.col("external_id").alias("value")).agg(F.min("set_id").alias("set_id"))
    each = first.select("candidate_id", "game", F.explode("ids").alias("i")).select("candidate_id", "game", "i.*").join(stored, ["game", "origin", "value"], "left")
    found = each.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("foreign", "origin", "value", "set_id"))).alias("found"))
    no_ids = F.array().cast("array<struct<key:string,set_id:string>>")
    ids = F.coalesce(F.transform("found", lambda e: F.struct(F.concat_ws("=", e["origin"], e["value"]).alias("key"), e["set_id"].alias("set_id"))), no_ids)
    taken = clear.join(found, "candidate_id", "left").select(
        F.lit(2).alias("kind"), F.lit(0).cast("long").alias("place"), F.col("candidate_id").alias("id"), "game", matchable.alias("name"), "key", code_in_name(n).alias("name_key"), "code",
        (F.col("key").isNotNull() & F.col("many").isNull()).alias("clear"), (F.col("own").isNotNull() & F.col("own_many").isNull()).alias("real"), ids.alias("ids"),
    )
    known = sets.select(F.lit(1).alias("kind"), F.col("created").alias("place"), F.col("set_id").alias("id"), "game", matchable.alias("name"), code_key(n, F.col("code"), F.col("synthetic")).alias("key"), "code")
    known = settled(_representatives(known)).withColumn("ids", no_ids)
    names = taken.select("game", "name").where("name is not null").distinct()
    pairs = name_pairs(names, known.select("game", "name").where("name is not null").unionByName(names).distinct()).select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("place"), "game", F.col("x").alias("name"), F.col("y").alias("other"), "score", no_ids.alias("ids"))
    together = settled(taken.unionByName(known, allowMissingColumns=True).unionByName(pairs, allowMissingColumns=True))
    fields = [f.split(" ")[0] for f in _FOLDED.split(", ")]
    ordered = _parted(together, whole_game).select(*fields).repartition("part").sortWithinPartitions("part", "kind", "place", "id")
    resolved = ordered.mapInArrow(_fold, "candidate_id string, set_id string, matched_by string")
    leaders = first.select("game", "origin", "class", "candidate_id").join(resolved, "candidate_id").select("game", "origin", "class", F.col("candidate_id").alias("_first"), "set_id", "matched_by")
    by = F.when(F.col("candidate_id") == F.col("_first"), F.col("matched_by")).otherwise("id").alias("matched_by")
    placed = rows.select("candidate_id", "game", "origin", "class").join(leaders, ["game", "origin", "class"]).select("candidate_id", "set_id", by)
    return candidates.join(placed, "candidate_id")


def outcomes(resolved: DataFrame) -> DataFrame:
    """Per game: candidates, sets they went to, and sets that two or more origins met in."""
    per_set = resolved.groupBy("game", "set_id").agg(F.count(F.lit(1)).alias("n"), (F.min("origin") != F.max("origin")).cast("int").alias("paired"))
    return per_set.groupBy("game").agg(F.sum("n").alias("candidates"), F.count(F.lit(1)).alias("sets"), F.sum("paired").cast("long").alias("paired"))
