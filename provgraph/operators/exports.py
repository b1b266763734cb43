"""Tables for reports: top edges, overview, provenance classes, diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.functions.enums import CLASSES
from provgraph.functions.scoring import verified


def overview(claims: DataFrame) -> DataFrame:
    """One row: nodes, edges, verified and inferred edges."""
    sure = verified(F.col("relation"), F.col("assurance"))
    # each claim once by itself and once for each end, so one pass gives both; nodes are counted by themselves
    end = lambda name: F.struct(F.lit(None).cast("boolean").alias("sure"), F.col(name).alias("node"))
    rows = claims.select(F.explode(F.array(F.struct(sure.alias("sure"), F.lit(None).cast("string").alias("node")), end("source_id"), end("target_id"))).alias("x"))
    each = rows.groupBy("x.node").agg(F.count("x.sure").alias("edges"), F.count_if("x.sure").alias("verified"))
    return each.agg(F.count("node").alias("nodes"), F.sum("edges").alias("edges"), F.sum("verified").alias("verified"), F.sum(F.col("edges") - F.col("verified")).alias("inferred"))


def top_edges(claims: DataFrame, n: int = 80) -> DataFrame:
    """The best edges by score, then ids."""
    return claims.orderBy(F.desc("score"), "source_id", "target_id").limit(n).select("source_id", "target_id", "relation", "score")


def provenance_class(edges: DataFrame) -> DataFrame:
    """The class of each relation in a provenance export."""
    return edges.groupBy("relation", class_of(F.col("relation")).alias("prov_class")).agg(F.count("*").alias("n"))


def class_of(relation: Column) -> Column:
    out = F.lit("Influence")
    for name, relations in CLASSES.items():
        out = F.when(relation.isin(relations), name).otherwise(out)
    return out


def normalized_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, key): edges, by path and relation, of one graph that the other lacks."""
    key = lambda df: df.select(F.concat_ws("|", "source_path", "relation", "target_path").alias("key"))
    a, b = key(left), key(right)
    return a.subtract(b).select(F.lit("left").alias("side"), "key").unionByName(b.subtract(a).select(F.lit("right").alias("side"), "key"))


def mermaid(edges: DataFrame, n: int = 80) -> str:
    """A diagram of the best edges; observed ones drawn thick."""
    rows = top_edges(edges, n).withColumn("arrow", F.when(F.col("relation") == "was_generated_by", "==>").otherwise("-.->")).collect()  # at most n
    return "\n".join(["flowchart LR", *(f'  "{r.source_id}" {r.arrow}|{r.relation}| "{r.target_id}"' for r in rows)])


def graph_json(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as JSON lines in a folder of its name; Spark writes the parts."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")


def provenance_export(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, item): a PROV graph as JSON-LD items, nodes (id, kind, label, path) and claims (claim_id, …).

    Every claim has its rank among the candidates of its target, by score and then id.
    """
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("score"), "claim_id"))
    type_ = F.when(F.col("kind").isin("run", "activity", "job"), "prov:Activity").when(F.col("kind") == "agent", "prov:Agent").otherwise("prov:Entity")
    iri = lambda kind, c: F.concat(F.lit(f"urn:{kind}:"), F.url_encode(c))
    ref = lambda c: F.struct(iri("node", c).alias("@id"))
    node = F.struct(iri("node", F.col("id")).alias("@id"), type_.alias("@type"), F.col("label").alias("label"), F.lit(True).alias("tfl:internalNode"), F.col("id").alias("tfl:internalId"), F.col("kind").alias("tfl:kind"), F.col("path").alias("tfl:path"))
    kind = class_of(F.col("relation"))
    a, b = F.col("source_id"), F.col("target_id")
    when = lambda name, c: F.when(kind == name, c)
    ends = [when("Usage", ref(b)).when(kind == "Association", ref(a)).when(kind == "Generation", ref(a)).alias("prov:activity"), when("Usage", ref(a)).when(kind == "Generation", ref(b)).alias("prov:entity"), when("Derivation", ref(a)).alias("prov:usedEntity"), when("Derivation", ref(b)).alias("prov:generatedEntity"), when("Association", ref(b)).alias("prov:agent"), when("Influence", ref(a)).alias("prov:influencer"), when("Influence", ref(b)).alias("tfl:influencee")]
    claim = F.struct(iri("relation", F.col("claim_id")).alias("@id"), F.concat(F.lit("prov:"), kind).alias("@type"), *ends, a.alias("tfl:internalSource"), b.alias("tfl:internalTarget"), F.col("relation").alias("tfl:internalRelation"), F.col("score").alias("tfl:score"), rank.alias("tfl:candidateRank"))
    return nodes.select(iri("node", F.col("id")).alias("id"), F.to_json(node).alias("item")).unionByName(claims.select(iri("relation", F.col("claim_id")).alias("id"), F.to_json(claim).alias("item")))


def explorer(claims: DataFrame, nodes: DataFrame, evidence: DataFrame, n: int = 1500, most: int = 6, chars: int = 400) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) that a page can show: the best active claims, the nodes at their ends, a few items of evidence each.

    ``evidence``: (claim_id, evidence_id, kind, facts). The kept edges are at most ``n``, so they are broadcast.
    """
    active = claims.where("status = 'active'") if "status" in claims.columns else claims
    kept = active.orderBy(F.desc("score"), "claim_id").limit(n)
    items = evidence.join(F.broadcast(kept.select("claim_id")), "claim_id", "left_semi").groupBy("claim_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("evidence_id", "kind", F.left("facts", F.lit(chars)).alias("facts")))), 1, most).alias("evidence"))
    ends = kept.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return kept.join(items, "claim_id", "left"), nodes.join(F.broadcast(ends), "id", "left_semi")


def explorer_filter(edges: DataFrame, minimum: float = 0.0, relation: str | None = None, text: str | None = None, focus: DataFrame | None = None) -> DataFrame:
    """Edges of at least a score, of a relation, with a text in an end's path or the relation, and both ends in a focus (node_id)."""
    out = edges.where(F.col("score") >= minimum)
    if relation:
        out = out.where(F.col("relation") == relation)
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "source_path", "relation", "target_path")), F.lit(text.lower())))
    if focus is not None:
        for end in ("source_id", "target_id"):
            out = out.join(focus.select(F.col("node_id").alias(end)).distinct(), end, "left_semi")
    return out


def notes(nodes: DataFrame, claims: DataFrame) -> DataFrame:
    """(note, id, text): a Markdown note for each node, with links to and from its neighbours, sorted.

    Note names follow from ids, so an export that is repeated writes the same files.
    """
    stem_ = F.regexp_replace(F.substring_index("path", "/", -1), r"[^\p{L}\p{N}._-]+", "-")
    named = nodes.select("id", "path", "kind", F.concat(stem_, F.lit("-"), F.left(F.sha2("id", 256), F.lit(8))).alias("note"))
    other = lambda me, far, arrow: claims.select(F.col(me).alias("id"), F.col(far).alias("far"), F.lit(arrow).alias("arrow"), "relation", "score")
    links = other("source_id", "target_id", "→").unionByName(other("target_id", "source_id", "←")).join(named.select(F.col("id").alias("far"), F.col("note").alias("far_note")), "far")
    lines = links.groupBy("id").agg(F.array_sort(F.collect_list(F.format_string("- %s [[%s]] %s %.2f", "arrow", "far_note", "relation", "score"))).alias("lines"))
    text = F.concat(F.lit("# "), F.col("path"), F.lit("\n\n"), F.coalesce(F.array_join("lines", "\n"), F.lit("")), F.lit("\n"))
    return named.join(lines, "id", "left").select("note", "id", text.alias("text"))


def preserved_notes(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(note, text, state) of notes against files (note, text, written_sha): written, unchanged, conflict.

    A file whose text is no longer what was last written was edited by hand: it keeps its text, and the
    new one goes beside it.
    """
    s = stored.select("note", F.col("text").alias("there"), "written_sha")
    both = fresh.join(s, "note", "left")
    edited = F.col("there").isNotNull() & (F.sha2("there", 256) != F.coalesce("written_sha", F.lit("")))
    state = F.when(F.col("there").isNull(), "written").when(edited & (F.col("there") != F.col("text")), "conflict").when(F.col("there") == F.col("text"), "unchanged").otherwise("written")
    return both.select(F.when(state == "conflict", F.concat("note", F.lit(".conflict"))).otherwise(F.col("note")).alias("note"), "text", state.alias("state"))


def markdown(title: str, rows: DataFrame, n: int = 60) -> str:
    """A table of the first rows of an answer, in the order of its columns."""
    shown = rows.orderBy(*rows.columns).limit(n).collect()  # at most n
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in shown), ""])
