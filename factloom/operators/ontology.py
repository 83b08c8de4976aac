"""Class hierarchy, properties of classes, labels, write schema and validation of an ontology.

``terms`` has one row per class, property or enumeration (``schemas.TERMS``). Lists of properties come as rows
with their sort columns (priority, nulls last, then id); no window numbers them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab as v
from ..functions import text
from ..functions.ids import is_blank
from ..functions.labels import pick_label
from ..session import cut_lineage, row_bound, small

_PROPERTY_KINDS = (v.DATATYPE_PROPERTY, v.OBJECT_PROPERTY)


class InvalidOntology(ValueError):
    """Missing parents, cycles or repeated ids."""


def unique_terms(terms: DataFrame) -> DataFrame:
    """The terms, or an error naming repeated ids."""
    repeated = terms.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    sample = [r["id"] for r in repeated.orderBy("id").limit(5).toLocalIterator()]
    if sample:
        raise InvalidOntology(f"repeated term ids: {', '.join(sample)}")
    return terms


def _classes(terms: DataFrame) -> DataFrame:
    return terms.where(F.col("kind") == v.CLASS)


def ancestors(terms: DataFrame, strict: bool = True) -> DataFrame:
    """(class_id, ancestor_id, depth): every class with itself (0) and all its ancestors.

    Doubles the reach each round. ``strict`` raises on a missing parent or a cycle; otherwise a parent that is
    no class ends the chain as its last member, and a cycle contributes each of its classes once.
    """
    own = _classes(terms).select("id", "parent")
    pairs = cut_lineage(own)
    known = pairs.select(F.col("id").alias("parent"))
    if strict:
        lost = pairs.where("parent is not null").join(known, "parent", "left_anti")
        sample = [f"{r['id']} -> {r['parent']}" for r in lost.orderBy("id").limit(5).toLocalIterator()]
        if sample:
            raise InvalidOntology(f"parent class is missing: {', '.join(sample)}")
    else:
        ends = pairs.where("parent is not null").join(known, "parent", "left_anti").select(F.col("parent").alias("id")).distinct()
        pairs = cut_lineage(pairs.unionByName(ends.withColumn("parent", F.lit(None).cast("string"))))
        known = pairs.select(F.col("id").alias("parent"))
    total = pairs.count()
    tiny = row_bound(pairs)
    hint = F.broadcast if tiny else (lambda df: df)
    jumps = cut_lineage(pairs.where("parent is not null").join(hint(known), "parent", "left_semi").select(
        F.col("id").alias("class_id"), F.col("parent").alias("far")))
    reach = pairs.select(F.col("id").alias("class_id"), F.col("id").alias("ancestor_id"), F.lit(0).alias("depth"))
    step, size = 1, total
    while not jumps.isEmpty():
        ahead = reach.select(F.col("class_id").alias("far"), "ancestor_id", "depth")
        new = jumps.join(ahead, "far").select("class_id", "ancestor_id", (F.col("depth") + step).alias("depth"))
        if strict:
            # a cycle shows in the round that reaches its length, before any row repeats
            new = cut_lineage(new)
            looped = [r["class_id"] for r in new.where("class_id = ancestor_id").orderBy("class_id").limit(5).toLocalIterator()]
            if looped:
                raise InvalidOntology(f"cyclic class hierarchy, for example through: {', '.join(looped)}")
            reach = reach.unionByName(new)
        else:
            # rows repeat around a cycle: keep the nearest, and stop when nothing new is reached
            reach = cut_lineage(reach.unionByName(new).groupBy("class_id", "ancestor_id").agg(F.min("depth").alias("depth")))
            before, size = size, reach.count()
            if size == before:
                break
        further = jumps.select(F.col("class_id").alias("far"), F.col("far").alias("next"))
        jumps = cut_lineage(jumps.join(hint(further), "far").select("class_id", F.col("next").alias("far")))
        step *= 2
    return reach if strict else reach.join(own.select(F.col("id").alias("class_id")), "class_id", "left_semi")


def is_a(rows: DataFrame, closure: DataFrame, class_id: str | Column, type_column: str = "type") -> DataFrame:
    """Rows whose type is the class or one of its descendants."""
    wanted = closure.where(F.col("ancestor_id") == class_id).select(F.col("class_id").alias(type_column))
    return rows.join(small(wanted), type_column, "left_semi")


def descendants(closure: DataFrame, class_id: str) -> DataFrame:
    return closure.where(F.col("ancestor_id") == class_id).select("class_id", "depth")


MANY = 100  # properties of one class from which on they are sent to its descendants


def _single_line(closure: DataFrame) -> bool:
    """True if every class has one parent at most: of two ancestors of a class one is then above the other."""
    near = closure.where("depth <= 1").groupBy("class_id", "depth").agg(F.count(F.lit(1)).alias("n"))
    return near.where("n > 1").isEmpty()


def _attached(properties: DataFrame, column: str) -> DataFrame:
    """(property_id, priority, ancestor_id) distinct."""
    return properties.select(F.col("id").alias("property_id"), "priority", F.explode(column).alias("ancestor_id")).distinct()


def _topmost(attached: DataFrame, closure: DataFrame) -> DataFrame:
    """The attached classes without those below another one of the same property (of a cycle the first stays): in a single line
    every class has one of a property's at most above it, so pairs need not be made distinct."""
    own = attached.select(F.struct("property_id", "priority").alias("p"), "ancestor_id")
    several = own.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("p")
    some = own.join(several, "p", "left_semi")
    up = closure.select(F.col("class_id").alias("ancestor_id"), F.col("ancestor_id").alias("above")).where("ancestor_id <> above")
    below = cut_lineage(some.join(up, "ancestor_id").join(some.select("p", F.col("ancestor_id").alias("above")), ["p", "above"], "left_semi"))
    back = below.select("p", F.col("ancestor_id").alias("above"), F.col("above").alias("ancestor_id"), F.lit(True).alias("mutual"))
    passed = below.join(back, ["p", "ancestor_id", "above"], "left").where("mutual is null or above < ancestor_id").select("p", "ancestor_id")
    return own.join(passed, ["p", "ancestor_id"], "left_anti").select("p.property_id", "p.priority", "ancestor_id")


def _inherited(attached: DataFrame, closure: DataFrame) -> DataFrame:
    """Rows of attached classes once for each of their descendants (``class_id``). A class with very many rows meets its descendants
    where they lie, so these are no single task."""
    reach = closure.select("class_id", "ancestor_id")
    often = cut_lineage(attached.groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MANY))
    if often.isEmpty() or not row_bound(attached.join(F.broadcast(often), "ancestor_id", "left_semi")):
        return attached.join(reach, "ancestor_id")
    hot = F.broadcast(often.select("ancestor_id"))
    here = reach.join(F.broadcast(attached.join(hot, "ancestor_id", "left_semi")), "ancestor_id")
    return attached.join(hot, "ancestor_id", "left_anti").join(reach, "ancestor_id").unionByName(here)


def _repeated(attached: DataFrame, closure: DataFrame) -> DataFrame:
    """``_inherited`` where a class may have several lines of ancestors: its pairs are made distinct."""
    return attached.join(closure.select("class_id", "ancestor_id"), "ancestor_id").select("class_id", "property_id", "priority").distinct()


def _by_ancestor(properties: DataFrame, column: str, closure: DataFrame) -> DataFrame:
    """(class_id, property_id, priority) for properties attached to an ancestor."""
    attached = _attached(properties, column)
    if not _single_line(closure):
        return _repeated(attached, closure)
    return _inherited(cut_lineage(_topmost(attached, closure)), closure).select("class_id", "property_id", "priority")


def direct_properties(terms: DataFrame, closure: DataFrame) -> DataFrame:
    """Properties whose domain is the class or an ancestor."""
    return _by_ancestor(terms.where(F.col("kind").isin(*_PROPERTY_KINDS)), "domains", closure)


def allowed_properties(pairs: DataFrame, terms: DataFrame, closure: DataFrame) -> DataFrame:
    """Those distinct (class_id, property_id) that ``direct_properties`` has; the properties of other classes are not made."""
    domains = _attached(terms.where(F.col("kind").isin(*_PROPERTY_KINDS)), "domains").select("property_id", "ancestor_id").distinct()
    return (pairs.select("class_id", "property_id").distinct().join(domains, "property_id")
            .join(closure.select("class_id", "ancestor_id"), ["class_id", "ancestor_id"], "left_semi").select("class_id", "property_id").distinct())


def inverse_properties(terms: DataFrame, closure: DataFrame) -> DataFrame:
    """Object properties whose range is the class or an ancestor."""
    return _by_ancestor(terms.where(F.col("kind") == v.OBJECT_PROPERTY), "ranges", closure)


def property_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("class_id", F.col("priority").asc_nulls_last(), "property_id")


def labelled(terms: DataFrame, language: str) -> DataFrame:
    """(id, kind, label, inverse_label) in the language, with its fallbacks; label falls back to null here."""
    return terms.select("id", "kind", pick_label("labels", language).alias("label"),
                        pick_label("inverse_labels", language).alias("inverse_label"))


def _enumeration_states(terms: DataFrame) -> DataFrame:
    return (terms.where(F.col("kind") == v.ENUMERATION)
            .select(F.col("id").alias("range_id"), F.posexplode("states").alias("pos", "s"))
            .select("range_id", "pos", F.col("s.value").alias("value"), F.col("s.label").alias("label"), F.col("s.lang").alias("lang")))


def enumeration_labels(terms: DataFrame, language: str) -> DataFrame:
    """(property_id, value, label) from the property's first enumeration range."""
    ranges = (terms.where(F.size("ranges") > 0)
              .select(F.col("id").alias("property_id"), F.posexplode("ranges").alias("at", "range_id")))
    enums = terms.where(F.col("kind") == v.ENUMERATION).select(F.col("id").alias("range_id"))
    first = (ranges.join(enums, "range_id").groupBy("property_id")
             .agg(F.min(F.struct("at", "range_id"))["range_id"].alias("range_id")))
    rank = F.when(F.lower("lang") == language.lower(), 0).when(F.col("lang").isNull(), 1) \
        .when(F.lower("lang") == "ru", 2).when(F.lower("lang") == "en", 3).otherwise(4)
    return (first.join(_enumeration_states(terms), "range_id").groupBy("property_id", "value")
            .agg(F.min(F.struct(rank.alias("rank"), "pos", "label"))["label"].alias("label")))


# --- write schema ------------------------------------------------------------------------------------

def schema_classes(terms: DataFrame, closure: DataFrame, language: str) -> DataFrame:
    """(class_id, label, parent, is_abstract, is_entity) of every class."""
    below = closure.where(F.col("ancestor_id") == v.SYSTEM_OBJECT).select("class_id", F.lit(True).alias("below"))
    return (_classes(terms).select(
        F.col("id").alias("class_id"), F.coalesce(pick_label("labels", language), "id").alias("label"), "parent", "is_abstract")
        .join(below, "class_id", "left")
        .select("class_id", "label", "parent", "is_abstract",
                (~F.col("is_abstract") & F.coalesce("below", F.lit(False))).alias("is_entity")))


def schema_properties(terms: DataFrame, closure: DataFrame, language: str, kinds: tuple[str, ...] = _PROPERTY_KINDS,
                      classes: DataFrame | None = None) -> DataFrame:
    """Writable properties of every class: (class_id, property_id, priority, label, inverse_label, kind, is_essential, ranges).

    ``kinds`` and ``classes`` (column class_id) are those asked for.
    """
    described = terms.where(F.col("kind").isin(*kinds)).select(
        F.col("id").alias("property_id"), F.coalesce(pick_label("labels", language), "id").alias("label"),
        pick_label("inverse_labels", language).alias("inverse_label"),
        F.when(F.col("kind") == v.OBJECT_PROPERTY, v.RESOURCE).otherwise(v.LITERAL).alias("kind"), "is_essential", "ranges")
    reach = closure if classes is None else closure.join(classes.select("class_id"), "class_id", "left_semi")
    attached = _attached(terms.where(F.col("kind").isin(*_PROPERTY_KINDS)), "domains")
    if _single_line(closure):  # described before they are given to the descendants, which are far more
        found = _inherited(cut_lineage(_topmost(attached, closure).join(described, "property_id")), reach)
    else:
        found = _repeated(attached, reach).join(described, "property_id")
    return found.select("class_id", "property_id", "priority", "label", "inverse_label", "kind", "is_essential", "ranges")


def schema_options(terms: DataFrame, language: str) -> DataFrame:
    """(property_id, value, label): choices of properties with enumeration ranges."""
    ranges = (terms.where(F.col("kind").isin(*_PROPERTY_KINDS))
              .select(F.col("id").alias("property_id"), F.posexplode("ranges").alias("at", "range_id")))
    rank = F.when(F.lower("lang") == language.lower(), 0).when(F.col("lang").isNull(), 1).otherwise(2)
    found = (ranges.join(_enumeration_states(terms), "range_id").groupBy("property_id", "value")
             .agg(F.min(F.struct(rank.alias("rank"), "at", "pos", "label"))["label"].alias("fallback")))
    return found.join(enumeration_labels(terms, language), ["property_id", "value"], "left").select(
        "property_id", "value", F.coalesce("label", "fallback", "value").alias("label"))


def relation_roles(terms: DataFrame, closure: DataFrame, language: str, types: DataFrame | None = None) -> DataFrame:
    """Roles a resource of a type can take in relation classes: (type, relation_class, property_id, label).

    Relation classes are concrete and no entities. ``types`` (first column) limits the types asked for.
    """
    relations = schema_classes(terms, closure, language).where("not is_abstract and not is_entity").select(
        "class_id", F.col("label").alias("class_label"))
    anchors = (schema_properties(terms, closure, language, (v.OBJECT_PROPERTY,), relations).join(relations, "class_id")
               .select(F.col("class_id").alias("relation_class"), "property_id", F.explode("ranges").alias("ancestor_id"),
                       F.concat_ws(": ", "class_label", F.coalesce("inverse_label", "label")).alias("label")))
    reach = closure.select(F.col("class_id").alias("type"), "ancestor_id")
    if types is not None:
        reach = reach.join(types.select(F.col(types.columns[0]).alias("type")), "type", "left_semi")
    return anchors.join(reach, "ancestor_id").select("type", "relation_class", "property_id", "label").distinct()


def entity_types_in_range(terms: DataFrame, closure: DataFrame, language: str) -> DataFrame:
    """(property_id, type, label): concrete entity types that fit the ranges of each object property."""
    entities = schema_classes(terms, closure, language).where("is_entity").select(F.col("class_id").alias("type"), "label")
    ranges = terms.where(F.col("kind") == v.OBJECT_PROPERTY).select(
        F.col("id").alias("property_id"), F.explode("ranges").alias("ancestor_id"))
    # the few pairs that end in a range first: pairs of the closure are far more than classes
    reach = ranges.join(closure.select(F.col("class_id").alias("type"), "ancestor_id"), "ancestor_id").select("property_id", "type").distinct()
    return reach.join(entities, "type").select("property_id", "type", "label").distinct()


# --- validation -----------------------------------------------------------------------------------------

ERROR, WARNING = "error", "warning"


def _has_text(labels: str) -> Column:
    return F.exists(labels, lambda x: ~is_blank(x["value"]))


def _cycles(classes: DataFrame, closure: DataFrame) -> DataFrame:
    """One row per cycle: the class that closes it, seen from the first class in file order that runs into it."""
    step = classes.where("parent is not null").select("id", "parent")
    inside = (step.join(closure.select(F.col("class_id").alias("parent"), F.col("ancestor_id").alias("id")), ["parent", "id"])
              .select("id", "parent"))
    reach = closure.join(inside.select(F.col("id").alias("ancestor_id")), "ancestor_id")
    ring = (reach.join(inside.select(F.col("id").alias("class_id")), "class_id", "left_semi")
            .groupBy(F.col("class_id").alias("id")).agg(F.min("ancestor_id").alias("ring")))
    # every class enters its ring at the nearest ring member
    entry = reach.groupBy("class_id").agg(F.min(F.struct("depth", F.col("ancestor_id").alias("id")))["id"].alias("id"))
    first = (entry.join(classes.select(F.col("id").alias("class_id"), "position"), "class_id").join(ring, "id")
             .groupBy("ring").agg(F.min(F.struct("position", "id"))["id"].alias("parent")))
    return inside.join(first, "parent").select("id")


def validate(terms: DataFrame) -> DataFrame:
    """(severity, code, term_id, detail) of every fault.

    ``terms`` may carry ``position`` (file order), which decides the class reported for a cycle; ids do otherwise.
    """
    if "position" not in terms.columns:
        terms = terms.withColumn("position", F.col("id"))
    terms = cut_lineage(terms)
    kinds = terms.select(F.col("id").alias("other"), F.col("kind").alias("other_kind"))
    classes = _classes(terms)
    closure = cut_lineage(ancestors(terms, strict=False))
    properties = terms.where(F.col("kind").isin(*_PROPERTY_KINDS))
    objects = terms.where(F.col("kind") == v.OBJECT_PROPERTY)
    found: list[DataFrame] = []

    def add(rows: DataFrame, severity: str, code: str, detail: str | None = None) -> None:
        found.append(rows.select(
            F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("id").alias("term_id"),
            (F.lit(None).cast("string") if detail is None else F.col(detail)).alias("detail")))

    def refer(rows: DataFrame, missing: str, wrong: str) -> None:
        checked = rows.join(kinds, "other", "left")
        add(checked.where("other_kind is null"), ERROR, missing, "other")
        add(checked.where(F.col("other_kind") != v.CLASS), ERROR, wrong, "other")

    root = classes.where(F.col("id") == v.SYSTEM_OBJECT).agg(F.count("*").alias("n")).where("n = 0")
    add(root.select(F.lit(v.SYSTEM_OBJECT).alias("id")), ERROR, "missing_entity_root")
    add(terms.where(~_has_text("labels")), WARNING, "missing_label")
    refer(classes.where(~is_blank("parent")).select("id", F.col("parent").alias("other")),
          "missing_parent_class", "parent_is_not_class")
    add(_cycles(classes, closure), ERROR, "cyclic_class_hierarchy")
    add(properties.where(F.size("domains") == 0), WARNING, "missing_domain")
    refer(properties.select("id", F.explode(F.array_distinct("domains")).alias("other")),
          "missing_domain_class", "domain_is_not_class")
    add(objects.where(F.size("ranges") == 0), ERROR, "missing_range")
    add(properties.where((F.col("kind") == v.DATATYPE_PROPERTY) & (F.size("ranges") == 0)), WARNING, "missing_range")
    ranged = objects.where(F.size("ranges") > 0)
    ranges = ranged.select("id", F.explode(F.array_distinct("ranges")).alias("other"))
    refer(ranges, "missing_range_class", "range_is_not_class")
    valid = ranges.join(kinds.where(F.col("other_kind") == v.CLASS), "other", "left_semi")
    concrete = (closure.where(F.col("ancestor_id") == v.SYSTEM_OBJECT)
                .join(classes.where("not is_abstract").select(F.col("id").alias("class_id")), "class_id", "left_semi").select("class_id"))
    reachable = closure.join(concrete, "class_id", "left_semi").select(F.col("ancestor_id").alias("other")).distinct()
    served = valid.join(reachable, "other", "left_semi").select("id")
    add(valid.select("id").distinct().join(served, "id", "left_anti"), ERROR, "no_concrete_entity_target")
    add(ranged.where(~_has_text("inverse_labels")), WARNING, "missing_inverse_label")
    return reduce(DataFrame.unionByName, found)


def fatal_report(spark, code: str, message: str) -> DataFrame:
    """The one-row report of a document that could not be read at all."""
    return spark.range(1).select(F.lit(ERROR).alias("severity"), F.lit(code).alias("code"),
                                 F.lit("$ontology").alias("term_id"), F.lit(message).alias("detail"))


def validation_summary(issues: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_count, error_count, warning_count, is_valid)."""
    counts = issues.agg(F.count(F.when(F.col("severity") == ERROR, 1)).alias("error_count"),
                        F.count(F.when(F.col("severity") == WARNING, 1)).alias("warning_count"))
    return terms.agg(F.countDistinct("id").alias("term_count")).crossJoin(counts).withColumn("is_valid", F.col("error_count") == 0)


# --- class search ---------------------------------------------------------------------------------------

def suggest_classes(terms: DataFrame, queries: DataFrame, language: str = "ru", limit: int | None = None) -> DataFrame:
    """(query_id, class_id, label, exact, is_abstract, place) for (query_id, query) rows of at least two characters.

    Exact matches first, then the shortest rest after the prefix, then label and id. Labels are stored under
    all their prefixes, so the match is an equi-join.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1, or none for all rows")
    label = F.coalesce(pick_label("labels", language), F.col("id"))
    forms = _classes(terms).select(
        F.col("id").alias("class_id"), label.alias("label"), "is_abstract",
        F.explode(F.concat(F.transform("labels", lambda x: x["value"]),
                           F.array(label, text.terminal_name("id")))).alias("form"))
    forms = forms.where(~is_blank("form")).withColumn("form", text.label_form("form")).distinct()
    keyed = forms.withColumn("key", F.explode(F.filter(text.prefixes("form"), lambda p: F.length(p) >= 2)))
    asked = queries.select("query_id", text.label_form("query").alias("key")).where(F.length("key") >= 2)
    hits = keyed.join(asked, "key").groupBy("query_id", "class_id", "label", "is_abstract").agg(
        F.min(F.length("form") - F.length("key")).alias("rest"))
    order = Window.partitionBy("query_id").orderBy("rest", F.lower("label"), "label", "class_id")
    placed = hits.withColumn("place", F.row_number().over(order))
    return ((placed if limit is None else placed.where(F.col("place") <= limit))
            .select("query_id", "class_id", "label", (F.col("rest") == 0).alias("exact"), "is_abstract", "place"))
