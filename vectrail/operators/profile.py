"""Events of an inference profile held against a reviewed list of the nodes that may run on the processor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of an element by number type, the suffix of kernel events, the two providers.
BYTES = {"int64": 8, "int32": 4, "float": 4, "float16": 2, "bool": 1}
SUFFIX, PROCESSOR, CARD = "_kernel_time", "CPUExecutionProvider", "CUDAExecutionProvider"
EVENT = "name string, args struct<provider: string, op_name: string, output_type_shape: array<map<string, array<bigint>>>, output_size: string>"
RULE = "node string, op_type string, outputs array<struct<dtype: string, max_elements: bigint, max_bytes: bigint>>"


def _elements(shape: Column) -> Column:
    """The product of a shape's dimensions; null for negative ones or beyond 64 bits."""
    product = F.aggregate(shape, F.lit(1).cast("decimal(38, 0)"), lambda n, d: F.when(d < 0, F.lit(None)).otherwise((F.least(n, F.expr("10000000000000000000BD")) * d).cast("decimal(38, 0)")))
    return F.when(product < F.expr("9223372036854775808BD"), product.cast("long"))


def verdicts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """``events`` with ``verdict``: what is wrong with each, by its first fault, or 'processor', 'card' or 'other' where nothing is.

    ``events`` has ``event``, a JSON object; ``rules`` as RULE, one row a node. An event that is no kernel's must name no
    provider. A kernel on the processor must be a listed node of the listed operator with the listed outputs: as many, each
    of the one listed type, neither empty nor over its bounds, together as large as the event says.
    """
    d = events.withColumn("_e", F.from_json("event", EVENT))
    kernel = F.coalesce(F.col("_e.name").endswith(SUFFIX), F.lit(False))
    d = d.withColumn("_node", F.when(kernel, F.expr(f"substring(_e.name, 1, length(_e.name) - {len(SUFFIX)})")))
    d = d.join(rules.select(F.col("node").alias("_node"), "op_type", F.col("outputs").alias("_rules"), F.lit(True).alias("_known")), "_node", "left")
    args = F.col("_e.args")
    sizes = F.create_map(*[F.lit(x) for kv in BYTES.items() for x in kv])

    def output(got: Column, rule: Column) -> Column:
        """(fault, bytes) of an output."""
        shape, each = F.try_element_at(got, rule["dtype"]), F.try_element_at(sizes, rule["dtype"])
        n = _elements(shape)
        fault = (
            F.when(shape.isNull(), "type").when(F.size(got) != 1, "ambiguous").when(n.isNull(), "shape").when(each.isNull(), "unknown type")
            .when((n == 0) | (n > rule["max_elements"]) | (n.cast("decimal(38, 0)") * each > rule["max_bytes"]), "bounds")
        )
        return F.struct(fault.alias("fault"), (n.cast("decimal(38, 0)") * each).alias("bytes"))

    d = d.withColumn("_o", F.zip_with(args["output_type_shape"], F.col("_rules"), output))
    first = F.filter(F.transform("_o", lambda o: o["fault"]), lambda f: f.isNotNull())
    total = F.aggregate("_o", F.lit(0).cast("decimal(38, 0)"), lambda n, o: (n + o["bytes"]).cast("decimal(38, 0)"))
    verdict = (
        F.when(~kernel & args["provider"].isNotNull(), "no kernel").when(~kernel, "other").when(args["provider"] == CARD, "card")
        .when(F.coalesce(args["provider"] != PROCESSOR, F.lit(True)), "provider").when(F.col("_known").isNull(), "not reviewed")
        .when(F.coalesce(args["op_name"] != F.col("op_type"), F.lit(True)), "operator").when(args["output_type_shape"].isNull(), "no outputs")
        .when(F.size(args["output_type_shape"]) != F.size("_rules"), "output count").when(F.size(first) > 0, F.try_element_at(first, F.lit(1)))
        .when(F.coalesce(args["output_size"].try_cast("decimal(38, 0)") != total, F.lit(True)), "output bytes").otherwise("processor")
    )
    return d.withColumn("verdict", verdict).drop("_e", "_node", "op_type", "_rules", "_known", "_o")


def check_run(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(processor, card, nodes): events on both and the processor's distinct nodes. Fails at a bad event, or where nothing ran on the card."""
    d = verdicts(events, rules)
    d = d.withColumn("_name", F.from_json("event", EVENT)["name"])
    bad = F.count_if(~F.col("verdict").isin("processor", "card", "other"))
    processor, card = (F.count_if(F.col("verdict") == v) for v in ("processor", "card"))
    checked = F.when(bad > 0, F.raise_error(F.lit("bad events"))).when(card == 0, F.raise_error(F.lit("nothing ran on the card"))).otherwise(card)
    return d.agg(processor.alias("processor"), checked.cast("long").alias("card"), F.countDistinct(F.when(F.col("verdict") == "processor", F.col("_name"))).alias("nodes"))
