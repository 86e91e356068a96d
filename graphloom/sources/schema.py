"""Record types and the codes of their open enumerations (codes that are not listed are kept as they are)."""

from pyspark.sql import types as T

# The codes are part of the data model.
EDGE_KINDS = {"owns": 0, "links": 1, "related": 2, "child_of": 3, "similar_to": 4}
MEMORY_TYPES = {"experience": 0, "concept": 1, "fact": 2, "decision": 3, "observation": 4, "preference": 5, "context": 6, "skill": 7, "intention": 8, "emotion": 9}
CONFIDENCE = {"very_low": 0, "low": 1, "medium": 2, "high": 3, "very_high": 4}
IMPORTANCE = {"trivial": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
SOURCES = {"user_input": 0, "llm_inference": 1, "external_tool": 2, "system_observation": 3, "memory_transfer": 4, "human_curation": 5}
RELATIONS = {"caused_by": 0, "similar_to": 1, "contradicts": 2, "supports": 3, "co_occurred": 4, "replaces": 5, "references": 6, "precedes": 7, "subset_of": 8, "user_pattern": 9}
ENTRY_TYPES = {"node": 0, "edge": 1, "vector": 2, "memory_content": 3}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_LONG, _SHORT, _INT, _TEXT, _TIME, _FLOAT, _BOOL = T.LongType(), T.ShortType(), T.IntegerType(), T.StringType(), T.TimestampType(), T.FloatType(), T.BooleanType()
NODES = _struct(id=_LONG, label=_TEXT)
EDGES = _struct(src=_LONG, dst=_LONG, kind=_SHORT)
VECTORS = _struct(id=_LONG, dims=T.ArrayType(_FLOAT))
MEMORY_CONTENT = _struct(memory_id=_LONG, content=_TEXT)
MEMORIES = _struct(id=_LONG, memory_type=_SHORT, content=_TEXT, confidence=_SHORT, importance=_SHORT, source=_SHORT, created_at=_TIME, last_accessed=_TIME, access_count=_LONG, session_id=_LONG, user_id=_LONG, version=_INT)
MEMORY_RELATIONS = _struct(src=_LONG, dst=_LONG, relation=_SHORT, strength=_FLOAT, created_at=_TIME, created_by=_SHORT)
SESSIONS = _struct(id=_LONG, user_id=_LONG, started_at=_TIME, last_active=_TIME, title=_TEXT, context=_TEXT, interaction_count=_LONG, is_active=_BOOL)
LOG = _struct(seq=_LONG, ts=_TIME, entry_type=_SHORT, node=NODES, edge=EDGES, vector=VECTORS, memory=MEMORY_CONTENT, deleted=_BOOL)
