"""Types of the engine's tables and the closed value sets of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
RELATIONS = ("contains", "references", "related-to", "applies-to", "requires", "generated-from")
TOPIC_TYPES = {"concept": "Concept", "task": "Task", "reference": "Reference", "glossentry": "Glossary Entry", "topic": "Topic"}
MAP_TYPE = "DITA Map"

_STRINGS = T.ArrayType(T.StringType())
LINK = T.StructType([T.StructField("relation", T.StringType()), T.StructField("target", T.StringType())])
MODEL = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("topicType", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("shortdesc", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("audience", _STRINGS),
        T.StructField("product", _STRINGS),
        T.StructField("keys", _STRINGS),
        T.StructField("uicontrols", _STRINGS),
        T.StructField("cmdUicontrols", _STRINGS),
        T.StructField("sourceFile", T.StringType()),
        T.StructField("links", T.ArrayType(LINK)),
    ]
)
NODES = "kind string, id string, topic_type string, okf_type string, title string, shortdesc string, body string, audience array<string>, product array<string>, keys array<string>, uicontrols array<string>, cmd_uicontrols array<string>, source_file string, node_ord long"
EDGES = "src string, dst string, relation string, edge_ord long"
DIAGNOSTICS = "id string, severity string, message string, subject string"

# Diagnostics and their severities.
SEVERITY = {"001E": "error", "010W": "warning", "020I": "info", "030E": "error", "040W": "warning", "050E": "error", "060W": "warning", "070W": "warning"}


def display_type(kind: Column, topic_type: Column) -> Column:
    shown = F.create_map(*[F.lit(x) for kv in TOPIC_TYPES.items() for x in kv])
    return F.when(kind == "map", F.lit(MAP_TYPE)).otherwise(F.element_at(shown, topic_type))


def strings(c: Column) -> Column:
    """A missing array is an empty one."""
    return F.coalesce(c, F.array().cast("array<string>"))
