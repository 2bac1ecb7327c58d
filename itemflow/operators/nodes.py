"""Axes and set operators on node tables.

A step takes the nodes of the table that stand on an axis of the context nodes, each once; document order is
(doc_id, pre).  Work is linear in nodes and contexts, also inside a document: axes by parent are joins on it; siblings
and what follows or precedes need the first or last context of a parent or document; what is inside or above needs a
running maximum or minimum over contexts and nodes in document order.  From the roots no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _alias(context: DataFrame) -> DataFrame:
    return context.select("doc_id", F.col("pre").alias("c_pre"), F.col("size").alias("c_size"), F.col("parent").alias("c_parent"), F.col("kind").alias("c_kind"))


def _not_attribute() -> Column:
    return F.col("kind") != "attribute"


def conditions() -> dict[str, Column]:
    """Join condition of each axis, besides the equal document."""
    inside = (F.col("pre") > F.col("c_pre")) & (F.col("pre") <= F.col("c_pre") + F.col("c_size"))
    above = (F.col("c_pre") > F.col("pre")) & (F.col("c_pre") <= F.col("pre") + F.col("size"))
    same = F.col("pre") == F.col("c_pre")
    sibling = (F.col("parent") == F.col("c_parent")) & _not_attribute() & (F.col("c_kind") != "attribute")
    return {
        "self": same,
        "child": (F.col("parent") == F.col("c_pre")) & _not_attribute(),
        "attribute": (F.col("parent") == F.col("c_pre")) & (F.col("kind") == "attribute"),
        "parent": F.col("pre") == F.col("c_parent"),
        "descendant": inside & _not_attribute(),
        "descendant-or-self": (inside & _not_attribute()) | same,
        "ancestor": above,
        "ancestor-or-self": above | same,
        "following-sibling": sibling & (F.col("pre") > F.col("c_pre")),
        "preceding-sibling": sibling & (F.col("pre") < F.col("c_pre")),
        "following": (F.col("pre") > F.col("c_pre") + F.col("c_size")) & _not_attribute(),
        "preceding": (F.col("pre") + F.col("size") < F.col("c_pre")) & _not_attribute(),
    }


def chosen(nodes: DataFrame, axis: str, name: str | None, kind: str | None) -> DataFrame:
    """The nodes that pass the node test."""
    kind = kind or ("attribute" if axis == "attribute" else "element" if name else None)
    if kind:
        nodes = nodes.where(F.col("kind") == kind)
    return nodes.where(F.col("name") == name) if name else nodes


def step(context: DataFrame, nodes: DataFrame, axis: str, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes on an axis of the context nodes, each once."""
    found = chosen(nodes, axis, name, kind)
    if axis in ("descendant", "descendant-or-self", "ancestor", "ancestor-or-self"):
        return _structural(context, found, axis)
    c = _alias(context).withColumnRenamed("doc_id", "c_doc")
    same = F.col("doc_id") == F.col("c_doc")
    if axis in ("following-sibling", "preceding-sibling"):
        after = axis == "following-sibling"
        edge = c.where("c_kind != 'attribute'").groupBy("c_doc", "c_parent").agg((F.min if after else F.max)("c_pre").alias("c_pre"))
        return found.where(_not_attribute()).join(edge, same & conditions_by_edge(after) & (F.col("parent") == F.col("c_parent")), "left_semi")
    if axis == "following":
        edge = c.groupBy("c_doc").agg(F.min(F.col("c_pre") + F.col("c_size")).alias("c_end"))
        return found.where(_not_attribute()).join(edge, same & (F.col("pre") > F.col("c_end")), "left_semi")
    if axis == "preceding":
        edge = c.groupBy("c_doc").agg(F.max("c_pre").alias("c_pre"))
        return found.where(_not_attribute()).join(edge, same & (F.col("pre") + F.col("size") < F.col("c_pre")), "left_semi")
    return found.join(c, same & conditions()[axis], "left_semi")


def conditions_by_edge(after: bool) -> Column:
    return F.col("pre") > F.col("c_pre") if after else F.col("pre") < F.col("c_pre")


def _structural(context: DataFrame, found: DataFrame, axis: str) -> DataFrame:
    """Nodes inside or above context nodes, by a running value over both in document order."""
    down, self_too = axis.startswith("descendant"), axis.endswith("-or-self")
    columns = found.columns
    marks = context.select("doc_id", "pre", (F.col("pre") + F.col("size") if down else F.col("pre")).alias("__mark")).distinct()
    both = found.withColumn("__mark", F.lit(None).cast("int")).unionByName(marks.withColumn("__mark", F.col("__mark").cast("int")), allowMissingColumns=True)
    # a node meets its own mark only on the axes with self
    first = F.col("__mark").isNotNull() if not self_too else F.col("__mark").isNull()
    order = Window.partitionBy("doc_id").orderBy(F.col("pre") if down else F.col("pre").desc(), first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = (F.max if down else F.min)("__mark").over(order)
    inside = F.col("__reach") >= F.col("pre") if down else F.col("__reach") <= F.col("pre") + F.col("size")
    hit = inside & (_not_attribute() if down else F.lit(True))
    if self_too and down:  # an attribute is on its own axis with self
        at = F.max(F.when(F.col("__mark").isNotNull(), F.col("pre"))).over(order)
        both, hit = both.withColumn("__at", at), inside & (_not_attribute() | (F.col("__at") == F.col("pre")))
    return both.withColumn("__reach", reach).where(F.col("__mark").isNull() & hit).select(*columns)


def pairs(context: DataFrame, nodes: DataFrame, axis: str, name: str | None = None, kind: str | None = None) -> DataFrame:
    """(doc_id, c_pre, node columns): the nodes on the axis of each context node."""
    left = _alias(context).withColumnRenamed("doc_id", "c_doc")
    found = chosen(nodes, axis, name, kind)
    return left.join(found, (F.col("doc_id") == F.col("c_doc")) & conditions()[axis]).drop("c_doc", "c_size", "c_parent", "c_kind")


def positioned(context: DataFrame, nodes: DataFrame, axis: str, name: str | None = None, kind: str | None = None) -> DataFrame:
    """``pairs`` with position() and last() on the axis, counted backwards on reverse axes."""
    found = pairs(context, nodes, axis, name, kind)
    order = F.col("pre").desc() if axis in ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent") else F.col("pre").asc()
    w = Window.partitionBy("doc_id", "c_pre")
    return found.withColumns({"position": F.row_number().over(w.orderBy(order)), "last": F.count("*").over(w)})


def from_roots(nodes: DataFrame, axis: str, name: str | None) -> DataFrame:
    """The first step of a path, which needs no join: a root is node 0 of its document and holds all others."""
    where = {"child": F.col("parent") == 0, "descendant": F.col("parent") >= 0, "descendant-or-self": F.lit(True), "self": F.col("parent") == -1}
    return chosen(nodes, axis, name, None).where(where[axis] & _not_attribute())


def path(nodes: DataFrame, *steps: tuple[str, str | None]) -> DataFrame:
    """Steps (axis, name) from the roots."""
    out, rest = nodes.where("parent = -1"), list(steps)
    if rest and rest[0][0] in ("child", "descendant", "descendant-or-self", "self"):
        out = from_roots(nodes, *rest.pop(0))
    for axis, name in rest:
        out = step(out, nodes, axis, name)
    return out


def string_value(context: DataFrame, nodes: DataFrame, name: str = "string") -> DataFrame:
    """The context's elements with the text of their subtrees, in document order."""
    texts = nodes.where("kind = 'text'").select(F.col("doc_id").alias("t_doc"), F.col("pre").alias("t_pre"), F.col("value").alias("t_value"))
    inside = (F.col("doc_id") == F.col("t_doc")) & (F.col("t_pre") > F.col("pre")) & (F.col("t_pre") <= F.col("pre") + F.col("size"))
    joined = context.join(texts, inside, "left")
    keys = [c for c in context.columns if c != "value"]
    gathered = F.array_sort(F.collect_list(F.when(F.col("t_pre").isNotNull(), F.struct("t_pre", "t_value"))))
    return joined.groupBy(*keys).agg(F.array_join(F.transform(gathered, lambda x: x["t_value"]), "").alias(name))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).dropDuplicates(["doc_id", "pre"])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id", "pre"), ["doc_id", "pre"], "left_semi")


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id", "pre"), ["doc_id", "pre"], "left_anti")


def innermost(context: DataFrame) -> DataFrame:
    """Nodes that hold no other node of the context: in document order, those not followed by one inside."""
    w = Window.partitionBy("doc_id").orderBy("pre")
    after = F.lead("pre").over(w)
    return context.withColumn("__after", after).where("__after is null or __after > pre + size").drop("__after")


def outermost(context: DataFrame) -> DataFrame:
    """Nodes that no other node of the context holds."""
    w = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.col("pre") + F.col("size")).over(w)
    return context.withColumn("__reach", reach).where("__reach is null or __reach < pre").drop("__reach")


def by_id(nodes: DataFrame, refs: DataFrame, column: str = "ref") -> DataFrame:
    """id(): elements whose id attribute is one of refs (doc_id, ref), white-space separated."""
    wanted = refs.select(F.col("doc_id").alias("r_doc"), F.explode(F.split(F.trim(F.col(column)), r"\s+")).alias("r_id")).distinct()
    ids = nodes.where("kind = 'attribute' and name = 'id'").select(F.col("doc_id").alias("i_doc"), F.col("parent").alias("i_pre"), F.trim("value").alias("i_id"))
    hit = ids.join(wanted, (F.col("i_doc") == F.col("r_doc")) & (F.col("i_id") == F.col("r_id")), "left_semi")
    return nodes.join(hit, (F.col("doc_id") == F.col("i_doc")) & (F.col("pre") == F.col("i_pre")), "left_semi")
