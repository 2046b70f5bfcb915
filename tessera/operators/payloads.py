"""Nested annotation payloads as VARIANT: tolerant parsing, and every violation of a payload as a row, in one pass without Python.

A payload is text that holds a JSON object: an event, and for each entity a full
set of predicates.  Nothing is raised: what can't be read is an error row, and a
value of a wrong type counts as absent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest evidence that is looked for in a text.
EVIDENCE = 80
_TOKEN = r'"(?:[^"\\]|\\.)*"|[{}]|[^"{}]+|"'


@dataclass(frozen=True)
class Schema:
    """What payloads must hold: predicate names that are true or false, those that are scores in [0, 1], components, and event types for each kind of source."""

    boolean: tuple[str, ...]
    score: tuple[str, ...]
    components: tuple[str, ...]
    events: dict[str, tuple[str, ...]]

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.boolean, *self.score)

    @property
    def event_types(self) -> list[str]:
        return sorted({e for kinds in self.events.values() for e in kinds})


def first_object(text: Column) -> Column:
    """The first balanced ``{...}`` of a text, braces inside strings apart; null without one.  Code fences and talk around it don't matter."""
    at = F.locate("{", text)
    tokens = F.regexp_extract_all(F.substr(text, at), F.lit(_TOKEN), F.lit(0))

    def step(state: Column, token: Column) -> Column:
        depth = state["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        length = state["length"] + F.length(token)
        done = state["done"] | (depth == 0)
        return F.when(state["done"], state).otherwise(F.struct(depth.alias("depth"), length.alias("length"), done.alias("done")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done"))
    end = F.aggregate(tokens, start, step)
    return F.when(at > 0, F.when(end["done"], F.substr(text, at, end["length"])))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that a row computes once: filters aren't moved below what a generator makes, where each use would compute it anew."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode_outer(F.array(value)).alias(name))


def parsed(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``body``: the first object of the payload as VARIANT, null where there is none."""
    return _once(payloads, "body", F.try_parse_json(first_object(F.col(payload))))


def _get(value: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path, kind)


def _text(value: Column, path: str) -> Column:
    return F.trim(F.coalesce(_get(value, path), F.lit("")))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _errors(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in pairs]))


def _predicates(schema: Schema, value: Column) -> Column:
    """Items of a predicate list: name, value, confidence and error, each by itself."""
    items = F.filter(F.coalesce(F.try_variant_get(value, "$.predicates", "array<variant>"), F.array().cast("array<variant>")), _is_object)

    def read(item: Column) -> Column:
        name, raw = _text(item, "$.name"), F.lower(_text(item, "$.value"))
        number = raw.try_cast("double")
        error = (
            F.when(~name.isin(*schema.names), "unknown_predicate")
            .when(name.isin(*schema.boolean) & ~raw.isin("true", "false"), "not_boolean")
            .when(name.isin(*schema.score) & (number.isNull() | F.isnan(number)), "not_a_score")
            .when(name.isin(*schema.score) & ~number.between(0, 1), "score_out_of_range")
        )
        shown = F.when(name.isin(*schema.score), F.format_string("%.2f", number)).otherwise(raw)
        return F.struct(name.alias("name"), shown.alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_get(item, "$.confidence", "double"), F.lit(0.0)))).alias("confidence"), error.alias("error"))

    return F.transform(items, read)


def _first_of_name(found: Column) -> Column:
    """Of a name the first valid item is taken, those after it are repeated."""
    taken = lambda i, name: F.exists(F.slice(found, 1, i), lambda p: p["error"].isNull() & (p["name"] == name))
    return F.transform(found, lambda p, i: F.struct(p["name"], p["value"], p["confidence"], F.when(taken(i, p["name"]), "repeated_predicate").otherwise(p["error"]).alias("error")))


def _document_errors(schema: Schema, text: str, kind: str) -> Column:
    """What is wrong with a payload as a whole and its event; an unreadable one has that error alone."""
    body = F.col("body")
    event = F.try_variant_get(body, "$.event", "variant")
    type_, evidence = _text(event, "$.event_type"), F.substring(_text(event, "$.evidence_text"), 1, EVIDENCE)
    allowed = F.create_map(*[x for k, kinds in schema.events.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in kinds]))])
    of_kind = F.coalesce(F.try_element_at(allowed, F.col(kind)), F.array(*[F.lit(e) for e in schema.event_types]))
    known = type_.isin(*schema.event_types)
    list_ = F.try_variant_get(body, "$.analyses", "array<variant>")
    given = F.try_variant_get(body, "$.analyses", "variant")
    found = _errors(
        ("unknown_event_type", ~known), ("event_type_of_other_source", known & ~F.array_contains(of_kind, type_)),
        ("evidence_not_in_text", (evidence == "") | ~F.contains(F.coalesce(F.col(text), F.lit("")), evidence)),
        *[(f"missing_{f}", _text(event, f"$.{f}") == "") for f in ("subject", "object", "impact_path")],
        ("analyses_no_array", given.isNotNull() & list_.isNull()), ("no_analyses", given.isNull() | (F.size(list_) == 0)),
    )
    return F.when(_is_object(body), found).otherwise(F.array(F.lit("unreadable")))


def document_errors(payloads: DataFrame, schema: Schema, key: str = "doc_id", text: str = "text", kind: str = "kind") -> DataFrame:
    """(key, entity null, error) of each payload as a whole.

    payloads: key, ``body`` (``parsed``), the text that evidence must come from, and the kind of its source; an unknown kind allows every type.
    """
    rows = _once(payloads, "__errors", _document_errors(schema, text, kind))
    return rows.select(key, F.lit(None).cast("string").alias("entity"), F.explode("__errors").alias("error"))


def analyses(payloads: DataFrame, entities: DataFrame, schema: Schema, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each entity that a payload names: key, place, entity, errors, predicates (name, value, confidence, error) and whether it is accepted.

    entities: one column ``entity`` of known ones.  The first row of a known entity counts; relations whose evidence isn't in
    the text are reported, but stay.  Accepted: known, first, all components there and every predicate given once and valid.
    """
    list_ = F.try_variant_get("body", "$.analyses", "array<variant>")
    first = F.array_position(F.transform(F.filter(list_, _is_object), lambda a: _text(a, "$.code")), F.col("entity")) - 1
    rows = payloads.select(key, text, "body", F.posexplode(F.filter(list_, _is_object)).alias("place", "__item")).withColumn("entity", _text(F.col("__item"), "$.code")).withColumn("__first", first)
    rows = rows.join(entities.select("entity", F.lit(True).alias("__known")), "entity", "left")
    evidence = F.substring(_text(F.col("__item"), "$.relationship_evidence"), 1, EVIDENCE)
    missing = F.array_except(F.array(*[F.lit(n) for n in schema.names]), F.transform(F.filter("predicates", lambda p: p["error"].isNull()), lambda p: p["name"]))
    parts = F.try_variant_get("__item", "$.score_components", "map<string,variant>")
    rows = _once(_once(rows, "__found", _predicates(schema, F.col("__item"))), "predicates", _first_of_name(F.col("__found")))
    stands = F.col("__known").isNotNull() & (F.col("place") == F.col("__first"))
    own = _errors(
        ("relationship_not_in_text", (evidence == "") | ~F.contains(F.coalesce(F.col(text), F.lit("")), evidence)),
        ("incomplete_components", ~F.coalesce(F.array_sort(F.map_keys(parts)) == F.array(*[F.lit(c) for c in sorted(schema.components)]), F.lit(False))),
        ("missing_predicates", F.size(missing) > 0),
    )
    inner = F.transform(F.filter("predicates", lambda p: p["error"].isNotNull()), lambda p: p["error"])
    errors = F.when(F.col("__known").isNull(), F.array(F.lit("unknown_entity"))).when(~stands, F.array(F.lit("repeated_entity"))).otherwise(F.concat(own, inner))
    accepted = stands & ~F.arrays_overlap(F.col("errors"), F.array(F.lit("missing_predicates"), F.lit("incomplete_components")))
    return _once(rows, "errors", errors).select(key, "place", "entity", "errors", missing.alias("missing"), "predicates", accepted.alias("accepted"))


def violations(payloads: DataFrame, entities: DataFrame, schema: Schema, key: str = "doc_id", text: str = "text", kind: str = "kind") -> DataFrame:
    """(key, entity, error) of all payloads; payloads as for ``parsed``, with the text and the kind of source."""
    read = parsed(payloads)
    rows = analyses(read, entities, schema, key, text).select(key, "entity", F.explode("errors").alias("error"))
    return document_errors(read, schema, key, text, kind).unionByName(rows)


def accepted_predicates(payloads: DataFrame, entities: DataFrame, schema: Schema, key: str = "doc_id", text: str = "text", kind: str = "kind") -> DataFrame:
    """(key, entity, name, value, confidence): predicates of accepted entities of payloads without an error of their own, in one pass over the rows.

    Each row is judged by itself: of payloads that share a key, or have none, those without errors stay.
    """
    read = _once(parsed(payloads), "__errors", _document_errors(schema, text, kind)).filter(F.size("__errors") == 0)
    rows = analyses(read, entities, schema, key, text).filter("accepted")
    return rows.select(key, "entity", F.explode(F.filter("predicates", lambda p: p["error"].isNull())).alias("p")).select(key, "entity", "p.name", "p.value", "p.confidence")


def consensus_map(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, predicates): typed predicate rows of each entity as one JSON object, names in order; scores as numbers, others as true or false."""
    typed = F.when(F.col("value").isin("true", "false"), F.col("value")).otherwise(F.col("value").cast("double").cast("string"))
    cells = F.array_sort(F.collect_list(F.concat(F.lit('"'), "name", F.lit('":'), typed)))
    return rows.groupBy(*keys).agg(F.concat(F.lit("{"), F.array_join(cells, ","), F.lit("}")).alias("predicates"))
