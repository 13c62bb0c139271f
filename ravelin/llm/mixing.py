"""Mixing sources to target weights: iterative proportional fitting (raking), then calibrated sampling.

Documents are added up to cells (source, language, topic); only cells go through the raking, so its cost depends on how
many cells there are. Each sweep scales the cells' weights to the target share of each source, then language, then topic.
A document of a cell is taken ``expected`` = budget x raked share of the cell / its natural share times on average: as many
whole copies as that has, and one more with the probability of the rest. So the sample meets the raked shares whatever the
budget is, small categories by being taken more than once; what raking itself leaves open is returned as ``residual``, the
largest gap between a category's raked share and its target. The draw is a hash of the document's id, so runs agree. A hot
source only makes one cell's sums larger (sums are made before the shuffle), and cells come back to the documents by a
broadcast that is used while there are at most ``broadcast_cells``. Texts are read once: what is counted of them is written
to the shared folder.

Only DataFrame functions are used. Results: null sources and languages are a category of their own, ''; a null text has no
tokens and is dealt like a text without words: it is taken once if no document of its cell has tokens; rows that repeat an id
get the same draw; if no document has tokens every one is taken once; an empty table gives no rows; extra columns are not
read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._store import Scratch

SWEEPS, DIMENSIONS = 8, ("source", "lang", "topic")
#: Tokens of the sample as a share of all, and the power that flattens the shares to targets.
BUDGET, FLATTEN = 0.8, 0.7


def n_tokens(text: Column) -> Column:
    """Words parted by space and \\x09-\\x0D."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the words of a text: code or tables, licences and notices, lists of contacts, prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains(" | ") | text.contains("$$$"), "tables")
        .when(text.contains("licensed") | text.contains("License") | text.contains("opyright"), "notices")
        .when(text.contains("@"), "contacts")
        .otherwise("prose")
    )


def flattened_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Each category's target share: its share of the tokens to a power below 1, which lifts small categories."""
    share = cells.groupBy(dimension).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("t"))
    return share.select(dimension, F.coalesce(F.col("t") / F.nullif(F.sum("t").over(W.partitionBy()), F.lit(0.0)), F.lit(0.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """Cells with a share whose sums by each dimension are close to the targets. Targets are shares of 1; a category without
    a target gets none of the weight."""
    out = cells.withColumn("share", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        out = out.join(target.withColumnRenamed("target", f"target_{dimension}"), dimension, "left")
    for _ in range(sweeps):
        for dimension in targets:
            total = F.sum("share").over(W.partitionBy(dimension))
            out = out.withColumn("share", F.when(total > 0, F.col("share") * F.coalesce(F.col(f"target_{dimension}"), F.lit(0.0)) / total).otherwise(0.0))
    return out


def residual(dimensions: tuple[str, ...]) -> Column:
    """The largest gap between a category's share and its target, over all categories."""
    gaps = [F.abs(F.sum("share").over(W.partitionBy(d)) - F.coalesce(F.col(f"target_{d}"), F.lit(0.0))) for d in dimensions]
    return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """Each cell's weight (raked share over natural share) and how often a document of it is taken on average."""
    everything = F.sum("tokens").over(W.partitionBy())
    out = cells.withColumn("weight", F.when(F.col("tokens") > 0, F.col("share") * everything / F.col("tokens")).otherwise(1.0))
    return out.withColumn("expected", F.when(F.col("tokens") > 0, budget * F.col("weight")).otherwise(1.0))


def draw(key: Column) -> Column:
    """A number in [0, 1) from 48 bits of the md5 of a key."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, power: float = FLATTEN, broadcast_cells: int = 50_000) -> DataFrame:
    """Per row: id, source, lang, topic, n_tokens, weight (raked share of all tokens over the natural share), expected (how often
    the row is taken on average), copies (how often it is taken), selected (at least once) and residual."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), (topic if topic is not None else topic_of(text)).alias("topic"), n_tokens(text).alias("n_tokens"))
    rows = Scratch(docs.sparkSession, "mixing").write(rows, "rows")
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    few = cells.limit(broadcast_cells + 1).count() <= broadcast_cells
    targets = targets or {d: flattened_targets(cells, d, power) for d in DIMENSIONS}
    raked = rake(cells, targets).withColumn("gap", residual(tuple(targets)))
    done = calibrate(raked, budget).select(*DIMENSIONS, "weight", "expected", F.max("gap").over(W.partitionBy()).alias("residual"))
    out = rows.join(F.broadcast(done) if few else done, list(DIMENSIONS))
    whole = F.floor("expected")
    out = out.withColumn("copies", (whole + (draw(F.col("id")) < F.col("expected") - whole).cast("long")).cast("long"))
    return out.select(F.col("id").alias(id_col), "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("expected", 6).alias("expected"), "copies", (F.col("copies") > 0).alias("selected"), F.round("residual", 6).alias("residual"))


def oracle() -> str:
    parts = []
    last = "t0"
    k = 0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            k += 1
            parts.append(f"t{k} as (select * replace (case when sum(share) over (partition by {d}) > 0 then share * target_{d} / sum(share) over (partition by {d}) else 0 end as share) from {last})")
            last = f"t{k}"
    targets = ", ".join(f"g_{d} as (select {d}, coalesce(pow(sum(tokens)::double, {FLATTEN}) / nullif(sum(pow(sum(tokens)::double, {FLATTEN})) over (), 0), 0) target_{d} from cells group by {d})" for d in DIMENSIONS)
    gaps = ", ".join(f"abs(sum(share) over (partition by {d}) - target_{d})" for d in DIMENSIONS)
    return f"""
with rows as (select doc_id, coalesce(source, '') source, coalesce(lang, '') lang,
  case when contains(coalesce(text, ''), ' | ') or contains(coalesce(text, ''), '$$$') then 'tables' when contains(coalesce(text, ''), 'licensed') or contains(coalesce(text, ''), 'License') or contains(coalesce(text, ''), 'opyright') then 'notices' when contains(coalesce(text, ''), '@') then 'contacts' else 'prose' end topic,
  len(list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> ''))::bigint n_tokens from documents),
cells as (select source, lang, topic, sum(n_tokens)::bigint tokens from rows group by all), {targets},
t0 as (select cells.*, tokens::double share, target_source, target_lang, target_topic from cells join g_source using (source) join g_lang using (lang) join g_topic using (topic)),
{", ".join(parts)},
g as (select *, greatest({gaps}) gap, case when tokens > 0 then share * sum(tokens) over () / tokens else 1 end weight from {last}),
e as (select source, lang, topic, weight, case when tokens > 0 then {BUDGET} * weight else 1 end expected, max(gap) over () residual from g),
c as (select *, (floor(expected) + (('0x' || md5(doc_id::varchar)[1:12])::bigint::double / {float(1 << 48)} < expected - floor(expected))::int)::bigint copies from rows join e using (source, lang, topic))
select doc_id, source, lang, topic, n_tokens, round(weight, 6) weight, round(expected, 6) expected, copies, copies > 0 selected, round(residual, 6) residual from c"""
