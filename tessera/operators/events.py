"""Events of dated documents: links of documents to entities, event types, event rows, and predicates grounded on texts and events.

Documents have doc_id, source_type, source_name, title, content and publish_time.  All is column work and joins with dimensions (entities, sectors, themes);
word lists come from ``functions.lexicon`` and can be replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import lexicon as words
from tessera.functions.scoring import evidence_score, source_reliability
from tessera.functions.text import cut_at_boundary, first_of, has_any
from tessera.operators.factors import burst
from tessera.operators.iterate import saved
from tessera.operators.retrieval import words_in


def own_text(content: Column) -> Column:
    """A content without the note that was added to it."""
    return F.substring_index(F.coalesce(content, F.lit("")), words.NOTE_MARK, 1)


def whole_text(joined_by: str = " ") -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(joined_by), own_text(F.col("content")))


def authoritative(kind: Column, name: Column) -> Column:
    return kind.isin(*words.AUTHORITATIVE_KINDS) | name.isin(*words.AUTHORITATIVE_NAMES)


def official(kind: Column, name: Column) -> Column:
    return (kind == "policy") | has_any(name, list(words.OFFICES))


def major_media(kind: Column, name: Column) -> Column:
    return (kind == "news") & name.isin(*words.MAJOR_MEDIA)


def specificity(text: Column) -> Column:
    """Share of four signs of a concrete fact: an action, a named subject, a quantity, a date or project."""
    signs = [has_any(text, list(words.ACTIONS)), text.rlike(words.SUBJECT), text.rlike(words.FACT_NUMBER), text.rlike(words.DATED_FACT)]
    return sum((s.cast("double") for s in signs), F.lit(0.0)) / len(signs)


def research_predicates(docs: DataFrame, schema: dict[str, tuple[str, ...]] = words.RESEARCH, by_source: bool = False) -> DataFrame:
    """(doc_id, name, value, evidence_text, confidence): each predicate of the schema, with the first of its words that the text holds.

    ``by_source`` adds what a source's kind tells: company announcements count as authoritative, sales bulletins and storage projects as demand.
    """
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    name = F.coalesce("source_name", F.lit(""))
    own = {n: first_of(text, list(w)) if w else F.lit(None).cast("string") for n, w in schema.items()}
    if "authoritative_source" in schema:
        own["authoritative_source"] = first_of(F.concat(name, F.lit(" "), text), list(schema["authoritative_source"]))
    if "quantitative_evidence" in schema:
        own["quantitative_evidence"] = F.regexp_substr(text, F.lit(words.QUANTITY))
    if by_source:
        announced = (F.col("source_type") == "official_company_announcement") | F.contains(name, F.lit("巨潮资讯"))
        bulletin = F.contains(F.coalesce("title", F.lit("")), F.lit("产销快报")) & F.contains(text, F.lit("新能源汽车"))
        storage = F.contains(text, F.lit("储能")) & has_any(text, list(words.STORAGE_GROWTH))
        told = {
            "quantitative_evidence": F.regexp_substr(text, F.lit(words.QUANTITY_WITH_COMMAS)), "authoritative_source": F.when(announced, name),
            "demand_ev_positive": F.when(bulletin, "产销快报"), "demand_storage_positive": F.when(storage, "储能"),
        }
        own |= {n: F.coalesce(told[n], own[n]) for n in told if n in own}
    # a source that is told by its kind counts even where its name is empty
    docs = docs.select("doc_id", *[e.alias(f"__{n}") for n, e in own.items()], *([F.coalesce(announced, F.lit(False)).alias("__announced")] if by_source else []))  # once, before they are exploded
    own = {n: F.col(f"__{n}") for n in own}
    held = {n: F.coalesce(e != "", F.lit(False)) | (F.col("__announced") if by_source and n == "authoritative_source" else F.lit(False)) for n, e in own.items()}
    rows = [F.struct(F.lit(n).alias("name"), held[n].alias("value"), F.coalesce(e, F.lit("")).alias("evidence_text"), F.when(held[n], 0.70).otherwise(0.65).alias("confidence")) for n, e in own.items()]
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("p")).select("doc_id", "p.*")


def event_type(kind: Column, text: Column, types: dict[str, tuple[str, ...]] = words.EVENT_TYPES, policy: tuple[str, ...] = words.POLICY_ACTIONS, attention: tuple[str, ...] = words.ATTENTION) -> Column:
    """The event type that a document's words name; null for questions and for documents that name none."""
    kind = F.coalesce(kind, F.lit(""))
    out = F.when(kind == "ir_qa", F.lit(None).cast("string")).when(kind == "policy", F.when(has_any(text, list(policy)), "policy_support"))
    for name, terms in types.items():
        out = out.when(has_any(text, list(terms)), name)
    return out.when((kind == "news") & has_any(text, list(attention)), "attention_spread")


def link_cascade(docs: DataFrame, pool: DataFrame, aliases: DataFrame, sector_words: list[tuple[str, str]] | None = None, themes: tuple = words.THEMES, representatives: int = words.THEME_ENTITIES) -> DataFrame:
    """(doc_id, entity, name, sector, confidence, evidence, link_pos): entities that a document names; policies and news that name none are linked by sector, else by theme.

    ``pool`` (entity, name, sector, size) and ``aliases`` (entity, alias) are dimensions; names are aliases too.  ``link_pos`` orders a document's links.
    """
    sector_words = [(s, w) for s, x in words.SECTORS.items() for w in x[3]] if sector_words is None else sector_words
    spark, text = docs.sparkSession, whole_text("\n")
    title, content = F.coalesce("title", F.lit("")), own_text(F.col("content"))
    read = docs.select("doc_id", "source_type", title.alias("title"), content.alias("content"), text.alias("text"))
    known = pool.select("entity", F.col("name").alias("alias")).unionByName(aliases.select("entity", "alias")).filter("alias <> ''").distinct()
    found = words_in(read, [r["alias"] for r in known.select("alias").distinct().collect()]).withColumnRenamed("word", "alias")
    named = found.join(F.broadcast(known), "alias").groupBy("doc_id", "entity").agg(F.min_by("alias", F.struct(-F.length("alias"), "alias")).alias("alias"))
    by_title, by_text = (lambda c: F.contains(F.col("title"), c)), (lambda c: F.contains(F.col("content"), c))
    sure = F.when(by_title(F.col("name")), words.DIRECT_LINK[0]).when(by_title(F.col("alias")), words.DIRECT_LINK[1]).when(by_text(F.col("name")), words.DIRECT_LINK[2]).otherwise(words.DIRECT_LINK[3])
    direct = (
        named.join(F.broadcast(pool), "entity").join(read.select("doc_id", "title", "content"), "doc_id")
        .select("doc_id", "entity", "name", "sector", sure.alias("confidence"), F.concat(F.when(by_title(F.col("alias")), "title: ").otherwise("text: "), "alias").alias("evidence"), F.lit(0).alias("__step"), (-F.length("alias")).alias("__at"))
    )
    direct = saved(direct)  # read twice, by what follows and by the result
    open_docs = read.filter(F.col("source_type").isin("policy", "news")).join(direct.select("doc_id").distinct(), "doc_id", "left_anti")
    is_policy = F.col("source_type") == "policy"
    steps = spark.createDataFrame([(s, w, i) for i, (s, w) in enumerate(sector_words)], "sector string, word string, at int")
    first_word = words_in(open_docs, [w for _, w in sector_words]).join(F.broadcast(steps), "word").groupBy("doc_id", "sector").agg(F.min_by("word", "at").alias("word"), F.min("at").alias("at"))
    first_word = saved(first_word)
    by_sector = (
        first_word.join(open_docs.select("doc_id", "source_type"), "doc_id").join(F.broadcast(pool), "sector")
        .select("doc_id", "entity", "name", "sector", F.when(is_policy, words.SECTOR_LINK[0]).otherwise(words.SECTOR_LINK[1]).alias("confidence"), F.concat(F.lit("sector: "), "word").alias("evidence"), F.lit(1).alias("__step"), F.col("at").alias("__at"))
    )
    rest = open_docs.join(first_word.select("doc_id").distinct(), "doc_id", "left_anti")
    ranked = pool.withColumn("__r", F.row_number().over(W.partitionBy("sector").orderBy(F.desc("size"), "entity"))).filter(F.col("__r") <= representatives)
    listed = spark.createDataFrame([(w, i, s, k, t) for i, (w, sectors, t) in enumerate(themes) for k, s in enumerate(sectors)], "word string, at int, sector string, step int, theme string")
    theme = words_in(rest, [t[0] for t in themes]).join(F.broadcast(listed.select("word", "at").distinct()), "word").groupBy("doc_id").agg(F.min_by("word", "at").alias("word"))
    by_theme = (
        theme.join(rest.select("doc_id", "source_type"), "doc_id").join(F.broadcast(listed), "word").join(F.broadcast(ranked), "sector")
        .select("doc_id", "entity", "name", "sector", F.when(is_policy, words.THEME_LINK[0]).otherwise(words.THEME_LINK[1]).alias("confidence"), F.concat(F.lit("theme: "), "word", F.lit(", "), "theme").alias("evidence"), F.lit(2).alias("__step"), (F.col("step") * 1000 + F.col("__r")).alias("__at"))
    )
    everything = direct.unionByName(by_sector).unionByName(by_theme)
    return everything.withColumn("link_pos", F.row_number().over(W.partitionBy("doc_id").orderBy("__step", "__at", "entity"))).drop("__at").withColumnRenamed("__step", "step")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the rows' numbers from 1 in the order of ``order``: rows are dealt by ranges of it, so no task numbers them all."""
    parts = saved(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row for each range
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__place", place).join(F.broadcast(before), "__part").withColumn(name, F.col("__place") + F.col("__before")).drop("__part", "__place", "__before")


def question_pressure(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, entity) of questions in a week with at least 3 on an entity, at more than twice the daily rate of the 30 days before."""
    asked = links.select("doc_id", "entity").join(docs.filter("source_type = 'ir_qa'").select("doc_id", F.col("publish_time").alias("day")), "doc_id")
    busy = burst(asked).filter((F.col("last_7") >= 3) & (F.col("last_7") / 7 > F.greatest(F.col("before_30") / 30, F.lit(0.05)) * 2))
    return asked.join(busy.select("entity", "day"), ["entity", "day"]).select("doc_id", "entity").distinct()


def evidence_sentence(title: Column, content: Column, name: Column, most: int = 80) -> Column:
    """The first sentence that names the entity or a priority word, else the title; cut at a sentence's mark."""
    lines = F.split(F.replace(own_text(content), F.lit("。"), F.lit("。\n")), r"\R")
    hit = F.get(F.filter(lines, lambda s: F.contains(s, name) | has_any(s, list(words.EVIDENCE_WORDS))), F.lit(0))
    return cut_at_boundary(F.coalesce(hit, title), most, ("。", "；", ";", "！", "？"))


def subject(kind: Column, title: Column, name: Column) -> Column:
    return F.when(kind == "announcement", F.substring_index(F.substring_index(title, "披露", 1), "发布", 1)).when(kind == "ir_qa", "投资者与公司管理层").otherwise(name)


def relationship(text: Column, name: Column, step: Column) -> Column:
    """1 where the text names the entity, 0.8 for links by sector, 0.6 by theme, else 0."""
    return F.when((name != "") & F.contains(text, name), 1.0).when(step == 1, 0.8).when(step == 2, 0.6).otherwise(0.0)


def build_events(docs: DataFrame, links: DataFrame, type_of: Column | None = None) -> DataFrame:
    """One event for each link of a document that has an event type.  Numbers count all links, in the order of documents and their links, so they don't depend on types."""
    links = saved(links)
    pressed = question_pressure(docs, links).withColumn("__pressed", F.lit(True))
    about = F.create_map(*[F.lit(x) for s, v in words.SECTORS.items() for x in (s, v[0])])
    path = F.create_map(*[F.lit(x) for s, v in words.SECTORS.items() for x in (s, v[1])])
    typed = docs.select("doc_id", "source_type", "source_name", "title", "content", "publish_time", (event_type(F.col("source_type"), whole_text()) if type_of is None else type_of).alias("__type"))
    met = numbered(links, ["doc_id", "link_pos"], "number").join(typed, "doc_id").join(pressed, ["doc_id", "entity"], "left")
    kind = F.when(F.coalesce("__pressed", F.lit(False)) & (F.col("source_type") == "ir_qa"), "investor_question_pressure").otherwise(F.col("__type"))
    found = evidence_sentence(F.col("title"), F.col("content"), F.col("name"))
    grounded = ((found != "") & F.contains(F.concat_ws("\n", "title", "content"), found)).cast("double")
    rows = met.withColumn("event_type", kind).filter("event_type IS NOT NULL").withColumn("evidence_text", found)
    score = evidence_score(source_reliability(F.col("source_type"), F.col("source_name"), list(words.MAJOR_MEDIA)), grounded, specificity(whole_text()), relationship(whole_text("\n"), F.col("name"), F.col("step")))
    return rows.select(
        F.concat(F.lit("E"), F.when(F.col("number") < 1000, F.lpad(F.col("number").cast("string"), 3, "0")).otherwise(F.col("number").cast("string"))).alias("event_id"),
        "doc_id", "entity", "sector", "event_type", F.col("publish_time").alias("event_time"), subject(F.col("source_type"), F.col("title"), F.col("source_name")).alias("subject"),
        F.try_element_at(about, F.col("sector")).alias("object"), F.try_element_at(path, F.col("sector")).alias("impact_path"), "evidence_text", F.round(score, 2).alias("evidence_strength"),
    )


def event_predicates(events: DataFrame, docs: DataFrame, priors: DataFrame) -> DataFrame:
    """(event_id, name, value, confidence): the Boolean predicates of each event, its evidence's strength, and the posterior (event_type, posterior) of its type, 0.50 if unknown."""
    text, kind, name, of = whole_text(), F.coalesce("source_type", F.lit("")), F.coalesce("source_name", F.lit("")), F.col("event_type")
    core = F.lit(False)
    for sector, (_, _, products, _) in words.SECTORS.items():
        core = core | ((F.col("sector") == sector) & has_any(text, list(products)))
    any_of = lambda terms: has_any(text, list(terms))
    digit = text.rlike(r"\d")
    policy = ((kind == "policy") | any_of(words.POLICY_FORM)) & any_of(words.POLICY_MATTER)
    trusted = authoritative(kind, name)
    values = {
        "has_policy_support": policy,
        "policy_directly_related_to_business": policy & core,
        "event_mentions_core_product": core,
        "evidence_from_authoritative_source": trusted,
        "event_policy_binding_strength": any_of(words.BINDING),
        "source_company_announcement": kind == "announcement",
        "source_major_media": major_media(kind, name),
        "event_scale_industry_level": any_of(words.INDUSTRY),
        "policy_attention_followup": (policy | (of == "attention_spread")) & (any_of(words.FOLLOW_UP) | (any_of(words.FOLLOW_UP_FACTS) & digit)),
        "event_mentions_export": any_of(words.EXPORT),
        "investor_questions_increase": (kind == "ir_qa") | any_of(words.QUESTIONS),
        "event_has_quantitative_target": text.rlike(words.TARGET_NUMBER) | (any_of(words.TARGET_WORDS) & digit),
        "announcement_contains_uncertainty": any_of(words.UNCERTAINTY),
        "risk_or_uncertainty_disclosure": any_of(words.UNCERTAINTY) | of.isin(*words.RISK_EVENTS),
        "demand_side_policy": policy & any_of(words.DEMAND_SIDE),
        "supply_side_policy": policy & any_of(words.SUPPLY_SIDE),
        "capacity_policy_support": (policy & any_of(words.CAPACITY)) | ((of == "capacity_expansion") & trusted),
    }
    row = lambda n, v, c: F.struct(F.lit(n).alias("name"), v.alias("value"), c.alias("confidence"))
    held = {n: F.col(f"__{n}") for n in values}
    rows = [row(n, v.cast("string"), F.when(v, words.EVENT_PREDICATES[n][0]).otherwise(words.EVENT_PREDICATES[n][1])) for n, v in held.items()]
    rows.append(row("event_evidence_strength", F.format_string("%.2f", F.col("evidence_strength")), F.lit(0.92)))
    rows.append(row("event_has_short_term_price_impact", F.format_string("%.2f", F.coalesce("posterior", F.lit(0.50))), F.lit(0.70)))
    met = events.select("event_id", "doc_id", "sector", "event_type", "evidence_strength").join(docs.select("doc_id", "source_type", "source_name", "title", "content"), "doc_id")
    met = met.join(F.broadcast(priors.select("event_type", "posterior")), "event_type", "left")  # a row for each event type
    met = met.select("event_id", "evidence_strength", "posterior", *[v.alias(f"__{n}") for n, v in values.items()])  # once, before they are exploded
    return met.select("event_id", F.explode(F.array(*rows)).alias("p")).select("event_id", "p.*")
