"""Entity resolution: merges, keys, links of graph nodes to entities, duplicate candidates, aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs, vocab
from ..storage import written
from .closure import ends_of, leading_to


def resolve_entities(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """entity_id, resolved_id, path_len, in_cycle: where active merges lead each entity.

    A walk stops where it comes back to itself, at the entity that it met again. Of several ends, the longest path
    decides, then the smallest id. Only sources of merges are followed; all others resolve to themselves.
    """
    found = ends_of(merges.filter("reverted = 0").select(F.col("from_id").alias("id"), F.col("into_id").alias("into")))
    found = found.select(F.col("id").alias("entity_id"), "at", (F.col("steps") + 1).alias("steps"), "cyc")
    return entities.select("entity_id").join(found, "entity_id", "left").select("entity_id", F.coalesce("at", "entity_id").alias("resolved_id"), F.coalesce("steps", F.lit(1)).alias("path_len"), F.coalesce("cyc", F.lit(False)).alias("in_cycle"))


def resolve_by_last_merge(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """entity_id, resolved_id by another rule and another way: of several active merges of an entity the last listed one
    (``ordinal``) holds, and walks go one step a round, stopping at the first entity met again."""
    last = merges.filter("reverted = 0").groupBy("from_id").agg(F.max_by("into_id", "ordinal").alias("into_id"))
    last = written(last.select(F.col("from_id").alias("at"), F.col("into_id").alias("next")), "last-merges")
    front, parts = last.select(F.col("at").alias("entity_id"), "at", F.array("at").alias("seen")), []
    while True:
        step = written(front.join(last, "at", "left").select("entity_id", F.coalesce("next", "at").alias("at"), (F.col("next").isNull() | F.array_contains("seen", F.col("next"))).alias("over"), F.array_append("seen", F.col("next")).alias("seen")), "steps")
        parts.append(step.filter("over").select("entity_id", "at"))
        front = step.filter("NOT over").select("entity_id", "at", "seen")
        if not front.limit(1).count():
            break
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return entities.select("entity_id").join(found, "entity_id", "left").select("entity_id", F.coalesce("at", "entity_id").alias("resolved_id"))


def entity_family(entities: DataFrame, merges: DataFrame, canonical_id: int) -> DataFrame:
    """All entities that merge into one, directly or not, and itself."""
    links = merges.filter("reverted = 0").select(F.col("from_id").alias("id"), F.col("into_id").alias("into"))
    return leading_to(links, canonical_id).select(F.col("id").alias("entity_id"))


def entity_keys(names: DataFrame, column: str) -> DataFrame:
    return names.withColumns({"canonical_display": exprs.rejoin_acronyms(F.col(column)), "normalized_name": exprs.name_key(F.col(column))})


def classify_entity(nodes: DataFrame) -> DataFrame:
    """Kind and country of nodes (label, type, named)."""
    kind = F.when(~F.coalesce("named", F.lit(True)), "unnamed").when(F.col("label").rlike(vocab.GOVERNMENT), "government")
    kind = kind.when((F.col("type") == "lender") & F.col("label").rlike(vocab.LENDING_INSTITUTION), "institution").otherwise("company")
    return nodes.withColumns({"entity_type": kind, "country": F.when(~F.col("label").rlike(vocab.FOREIGN), "IN")})


def link_nodes_to_entities(nodes: DataFrame, aliases: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (doc_id, node_id, label, named) to entities (entity_key, normalized_name): links, new entities, new aliases.

    An unnamed node is an entity of its own. A named one takes the entity of its key's only alias, else the entity with
    that key, else a new one, one for each key.
    """
    keyed = nodes.withColumn("key", exprs.name_key(F.col("label")))
    one = aliases.groupBy("key").agg(F.count("*").alias("n"), F.first("entity_key").alias("by_alias")).filter("n = 1").drop("n")
    by_name = entities.groupBy(F.col("normalized_name").alias("key")).agg(F.min("entity_key").alias("by_name"))
    linked = keyed.join(one, "key", "left").join(by_name, "key", "left")
    named = F.coalesce("named", F.lit(True))
    entity = F.when(~named, F.concat_ws(":", F.lit("unnamed"), F.col("doc_id").cast("string"), F.col("node_id"))).otherwise(F.coalesce("by_alias", "by_name", F.concat(F.lit("new:"), F.col("key"))))
    links = linked.select("doc_id", "node_id", "label", "key", entity.alias("entity_key"), (named & F.coalesce("by_alias", "by_name").isNull() | ~named).alias("is_new"))
    new = links.filter("is_new").groupBy("entity_key").agg(F.min(F.struct("doc_id", "node_id", "label")).alias("f")).select("entity_key", F.col("f.label").alias("canonical_name"), F.col("f.doc_id").alias("first_doc"))
    fresh = links.filter(~F.col("entity_key").startswith("unnamed:")).groupBy("key", "entity_key").agg(F.min(F.struct("doc_id", "label")).alias("f"))
    new_aliases = fresh.join(aliases.select("key", "entity_key"), ["key", "entity_key"], "left_anti").select("key", "entity_key", F.col("f.label").alias("raw_name"), F.col("f.doc_id").alias("source_document"))
    return links, new, new_aliases


def duplicate_candidates(usage: DataFrame, rejections: DataFrame | None = None, inactive: DataFrame | None = None, jaccard: float = 0.8, min_len: int = 4, relink: bool = True) -> DataFrame:
    """Pairs of entities (id, key, claims) that may be one: left, right, confidence, suggested.

    Signals: one key within the other, word overlap, equal keys after an end word is cut. Pairs meet by what they must
    share: each key is looked up under the rarest 4-gram of the shorter one, under words, and under trimmed forms; equal
    keys are one row first, so a common name makes no pairs among its own copies. A rejected pair alone goes: where it
    stood for others, the entities are linked by pairs that nobody rejected (unless ``relink`` is off).
    """
    rows = usage.filter(F.length("key") > 0)
    if inactive is not None:
        rows = rows.join(inactive.select("id"), "id", "left_anti")
    names = rows.select("key").distinct()
    grams = names.filter(F.length("key") >= min_len).select("key", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - (min_len - 1)), lambda i: F.substring("key", i, F.lit(min_len))))).alias("gram"))
    rare = grams.join(grams.groupBy("gram").agg(F.count("*").alias("df")), "gram").groupBy("key").agg(F.min(F.struct("df", "gram")).alias("r")).select(F.col("key").alias("a"), F.col("r.gram").alias("gram"))
    inside = rare.join(grams.select(F.col("key").alias("b"), "gram"), "gram").filter((F.col("a") != F.col("b")) & F.contains("b", "a")).select("a", "b")
    # of any two word sets with this overlap, the rarest words that one can't do without meet
    words = names.select("key", F.explode(F.array_distinct(F.split("key", " "))).alias("word"), F.size(F.array_distinct(F.split("key", " "))).alias("n"))
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    order = Window.partitionBy("key").orderBy("df", "word")
    prefix = words.join(df, "word").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * jaccard) + 1)
    overlap = prefix.select(F.col("key").alias("a"), "word").join(prefix.select(F.col("key").alias("b"), "word"), "word").filter("a != b").filter(exprs.jaccard(F.col("a"), F.col("b")) >= jaccard).select("a", "b")
    forms = names.withColumn("w", F.split("key", " ")).filter(F.size("w") >= 2)
    trims = F.array(F.expr("slice(w, 2, size(w) - 1)"), F.expr("slice(w, 1, size(w) - 1)"))
    cut = forms.select("key", F.explode(F.filter(trims, lambda x: F.size(x) >= 2)).alias("form")).select("key", F.array_join("form", " ").alias("form"), F.lit(True).alias("trimmed"))
    whole = forms.select("key", F.col("key").alias("form"), F.lit(False).alias("trimmed"))
    either = cut.unionAll(whole).distinct()
    trimmed = either.select(F.col("key").alias("a"), "form", F.col("trimmed").alias("ta")).join(either.select(F.col("key").alias("b"), "form", F.col("trimmed").alias("tb")), "form").filter("a != b AND (ta OR tb)").select("a", "b").withColumn("trim", F.lit(True))
    pairs = inside.withColumn("trim", F.lit(False)).unionAll(overlap.withColumn("trim", F.lit(False))).unionAll(trimmed)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "trim").groupBy("a", "b").agg(F.max("trim").alias("trim"))
    same = names.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(False).alias("trim"))
    short = F.least(F.length("a"), F.length("b"))
    j = exprs.jaccard(F.col("a"), F.col("b"))
    scored = pairs.unionAll(same).withColumn("confidence", F.greatest(F.when((short >= min_len) & (F.contains("a", "b") | F.contains("b", "a")), 0.95).otherwise(0.0), F.when(j >= jaccard, F.least(F.lit(0.92), 0.7 + j / 4)).otherwise(0.0), F.when(F.col("trim"), 0.88).otherwise(0.0)))
    # rows of one key are a star around its first id, so many copies of a name stay linear
    first = rows.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    heads = scored.filter("a != b").join(first.select(F.col("key").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("key").alias("b"), F.col("first").alias("y")), "b").select("x", "y", "confidence")
    stars = scored.filter("a = b").join(rows.select(F.col("key").alias("a"), F.col("id").alias("y")), "a").join(first.select(F.col("key").alias("a"), F.col("first").alias("x")), "a").filter("x != y").select("x", "y", "confidence")
    found = heads.unionAll(stars).select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "confidence")
    if rejections is not None:
        gone = rejections.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))
        found = _without_rejected(found, rows.select("id", "key"), rejections) if relink else found.join(gone, ["left_id", "right_id"], "left_anti")
    info = rows.select("id", "key", "claims")
    for side in ("left", "right"):
        found = found.join(info.select(F.col("id").alias(f"{side}_id"), F.col("key").alias(f"{side}_key"), F.col("claims").alias(f"{side}_claims")), f"{side}_id")
    left_wins = (F.col("left_claims") > F.col("right_claims")) | ((F.col("left_claims") == F.col("right_claims")) & ((F.col("left_key") < F.col("right_key")) | ((F.col("left_key") == F.col("right_key")) & (F.col("left_id") < F.col("right_id")))))
    return found.withColumn("suggested", F.when(left_wins, F.col("left_id")).otherwise(F.col("right_id")))


def _without_rejected(found: DataFrame, rows: DataFrame, rejections: DataFrame) -> DataFrame:
    """Candidates ``found`` (left_id, right_id, confidence) of entities ``rows`` (id, key) without rejected pairs, and with
    others in place of those, so that the same entities hang together as in all pairs without the rejected ones.

    A copy of a name that may not go with the first id goes with the least other one that may, of those that stay with
    the first; without any, with all other copies that it may go with. Two keys are linked by the first pair that is not
    rejected. As many ids of a key are looked at as it has rejections, and one more.
    """
    gone = rejections.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id")).filter("left_id != right_id").distinct()
    side = lambda s: rows.select(F.col("id").alias(f"{s}_id"), F.col("key").alias(f"{s}_key"))
    keyed = gone.join(side("left"), "left_id").join(side("right"), "right_id")
    lost = found.join(keyed, ["left_id", "right_id"])
    left = found.join(gone, ["left_id", "right_id"], "left_anti")

    # copies of one name: the first id has the smaller place in each of its pairs
    hit = lost.filter("left_key = right_key").select(F.col("left_key").alias("key"), F.col("right_id").alias("y"), "confidence")
    both = keyed.filter("left_key = right_key").select(F.col("left_key").alias("key"), F.col("left_id").alias("y"), F.col("right_id").alias("z"))
    both = both.unionAll(both.select("key", F.col("z").alias("y"), F.col("y").alias("z")))
    hit = hit.join(both.groupBy("key", "y").agg(F.count("*").alias("n")), ["key", "y"])
    stay = rows.join(hit.select("key").distinct(), "key", "left_semi").join(hit.select(F.col("y").alias("id")), "id", "left_anti")
    stay = stay.select("key", F.col("id").alias("z"), F.row_number().over(Window.partitionBy("key").orderBy("id")).alias("place"))
    free = hit.join(stay, "key").filter("place <= n + 1").drop("place").join(both, ["key", "y", "z"], "left_anti")
    near = free.groupBy("key", "y", "confidence").agg(F.min("z").alias("z")).select("key", "y", "z", "confidence")
    alone = hit.join(near, ["key", "y"], "left_anti").select("key", "y", "confidence")
    rest = alone.join(hit.select("key", F.col("y").alias("z")), "key").filter("y != z").join(both, ["key", "y", "z"], "left_anti").select("key", "y", "z", "confidence")
    copies = near.unionAll(rest).select(F.least("y", "z").alias("left_id"), F.greatest("y", "z").alias("right_id"), "confidence")

    # two keys
    keys = [F.least("left_key", "right_key").alias("a"), F.greatest("left_key", "right_key").alias("b")]
    cut = lost.filter("left_key != right_key").select(*keys, "confidence").join(keyed.select(*keys).groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"])
    used = cut.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ranked = rows.join(used, "key", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    x = ranked.select(F.col("key").alias("a"), F.col("id").alias("x"), F.col("place").alias("px"))
    y = ranked.select(F.col("key").alias("b"), F.col("id").alias("y"), F.col("place").alias("py"))
    pairs = cut.join(x, "a").filter("px <= n + 1").join(y, "b").filter("py <= n + 1").withColumns({"left_id": F.least("x", "y"), "right_id": F.greatest("x", "y")})
    pairs = pairs.join(gone, ["left_id", "right_id"], "left_anti").groupBy("a", "b", "confidence").agg(F.min(F.struct(F.col("px") + F.col("py"), "left_id", "right_id")).alias("f"))
    return left.unionByName(copies).unionByName(pairs.select("f.left_id", "f.right_id", "confidence")).distinct()


def apply_merges(requests: DataFrame, entities: DataFrame, merges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests (from_id, into_id): new merge rows, aliases at their new homes without repeats, and rejects with a reason."""
    kinds = entities.select("entity_id", "entity_type")
    checked = requests.join(kinds.select(F.col("entity_id").alias("from_id"), F.col("entity_type").alias("from_type")), "from_id", "left").join(kinds.select(F.col("entity_id").alias("into_id"), F.col("entity_type").alias("into_type")), "into_id", "left")
    active = merges.filter("reverted = 0").select("from_id").distinct().withColumn("active", F.lit(True))
    checked = checked.join(active, "from_id", "left")
    reason = F.when(F.col("from_id") == F.col("into_id"), "same entity").when(F.col("from_type").isNull() | F.col("into_type").isNull(), "unknown entity").when((F.col("from_type") == "unnamed") | (F.col("into_type") == "unnamed"), "unnamed entity").when(F.col("active"), "already merged")
    judged = checked.withColumn("reason", reason)
    new = judged.filter("reason IS NULL").select("from_id", "into_id", F.lit(0).alias("reverted"))
    homes = aliases.join(new.select(F.col("from_id").alias("entity_id"), "into_id"), "entity_id", "left")
    moved = homes.select(F.coalesce("into_id", "entity_id").alias("entity_id"), "raw_name", "doc_id").withColumn("key", exprs.name_key(F.col("raw_name")))
    kept = moved.groupBy("key", "entity_id").agg(F.min(F.struct("doc_id", "raw_name")).alias("f")).select("entity_id", "key", F.col("f.raw_name").alias("raw_name"), F.col("f.doc_id").alias("doc_id"))
    return new, kept, judged.filter("reason IS NOT NULL").select("from_id", "into_id", "reason")


def seed_alias_groups(alias_map: DataFrame, entities: DataFrame) -> DataFrame:
    """Curated names (raw, canonical) to merges: entities (id, name, key, claims) whose name or key fits a group, and the
    one they merge into: the one of exactly the canonical name, else the one with most claims."""
    # a key starts with a name where it has the name as its prefix of that length; the lengths of curated names are few
    keyed = alias_map.select("canonical", F.explode(F.array(exprs.name_key(F.col("raw")), exprs.name_key(F.col("canonical")))).alias("prefix")).filter("prefix IS NOT NULL").distinct()
    lengths = [r[0] for r in keyed.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]
    rows = entities.select("id", "name", "claims", "key")
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("key"))
    # people curate the names, so these go to the tasks that read entities, and not the other way round
    by_key = rows.withColumn("prefix", F.explode(F.transform(fits, lambda n: F.substring("key", F.lit(1), n)))).join(F.broadcast(keyed), "prefix")
    by_name = rows.join(F.broadcast(alias_map.select("canonical").distinct().withColumn("name", F.col("canonical"))), "name")
    group = by_key.select("canonical", "id", "name", "claims").unionByName(by_name.select("canonical", "id", "name", "claims")).distinct()
    best = group.groupBy("canonical").agg(F.max_by("id", F.struct((F.col("name") == F.col("canonical")).cast("int"), "claims", -F.col("id"))).alias("into_id"))
    return group.join(F.broadcast(best), "canonical").filter("id != into_id").select("canonical", F.col("id").alias("from_id"), "into_id")


def seed_rejections(names: DataFrame, entities: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of names that are not one entity, as sorted pairs of ids that are not known yet."""
    keyed = names.select(exprs.name_key(F.col("left_name")).alias("lk"), exprs.name_key(F.col("right_name")).alias("rk"))
    ids = entities.groupBy("key").agg(F.min("id").alias("id"))
    found = keyed.join(ids.select(F.col("key").alias("lk"), F.col("id").alias("x")), "lk").join(ids.select(F.col("key").alias("rk"), F.col("id").alias("y")), "rk").filter("x != y")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(known, ["a", "b"], "left_anti")


def match_or_create_companies(names: DataFrame, companies: DataFrame) -> DataFrame:
    """Names (name, ordinal) to companies (company_id, name, slug): the one with the same key, else a new slug with -2,
    -3 and so on where it is taken."""
    keyed = names.groupBy(exprs.name_key(F.col("name")).alias("key")).agg(F.min(F.struct("ordinal", "name")).alias("f")).select("key", F.col("f.name").alias("name"), F.col("f.ordinal").alias("ordinal"))
    own = companies.groupBy(exprs.name_key(F.col("name")).alias("key")).agg(F.min("company_id").alias("company_id"))
    matched = keyed.join(own, "key", "left")
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    base = F.regexp_replace(F.col("slug"), r"-\d+$", "")
    taken = companies.select(F.explode(F.array_distinct(F.array("slug", base))).alias("base"), "slug").groupBy("base").agg(F.max(F.coalesce(F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("int"), F.lit(1))).alias("top"))
    new = matched.filter("company_id IS NULL").withColumn("base", slug).join(taken, "base", "left")
    place = F.row_number().over(Window.partitionBy("base").orderBy("ordinal")) + F.coalesce("top", F.lit(0))
    created = new.withColumn("place", place).select("key", "name", F.lit(None).cast("long").alias("company_id"), F.when(F.col("place") > 1, F.concat_ws("-", "base", F.col("place").cast("string"))).otherwise(F.col("base")).alias("slug"))
    known = matched.filter("company_id IS NOT NULL").join(companies.select("company_id", "slug"), "company_id").select("key", "name", "company_id", "slug")
    return known.unionByName(created)


def name_lookup(entities: DataFrame, aliases: DataFrame, resolved: DataFrame) -> DataFrame:
    """Key of a name to the entity that it resolves to; aliases go before canonical names, then the smaller id."""
    own = entities.select(exprs.name_key(F.col("canonical_name")).alias("key"), "entity_id", F.lit(1).alias("rank"))
    other = aliases.select(exprs.name_key(F.col("raw_name")).alias("key"), "entity_id", F.lit(0).alias("rank"))
    both = own.unionAll(other).join(resolved.select("entity_id", "resolved_id"), "entity_id")
    return both.groupBy("key").agg(F.min(F.struct("rank", "resolved_id")).alias("f")).select("key", F.col("f.resolved_id").alias("entity_id"))
