"""Fixed schemas of the evidence model; readers never infer, and unknown keys are findings."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_IDS = T.ArrayType(_S)
BOX = _struct(x0=_D, y0=_D, x1=_D, y1=_D)
BLOCK = _struct(
    block_id=_S, paper_id=_S, source_path=_S, source_kind=_S, section_path=_S, block_type=_S, text=_S, page_number=_L, xml_element_id=_S, table_number=_S,
    figure_number=_S, char_start=_L, char_end=_L, parser=_S, parser_confidence=_D, locator_id=_S, bbox=BOX, table_html=_S, caption_text=_S, image_ref=_S,
    image_sha256=_S, verification_status=_S, verification_method=_S,
)
HIT = _struct(query_id=_S, block_id=_S, paper_id=_S, text=_S, section_path=_S, source_path=_S, page_number=_L, fused_score=_D, entity_types=_IDS)
SOURCE = _struct(source_id=_S, source_path=_S, section=_S, subsection=_S, block_type=_S, page_number=_L)
EVIDENCE = _struct(evidence_id=_S, text=_S, source_ids=_IDS, field_groups=_IDS, retrieval_field_tags=_IDS, experiment_candidate_ids=_IDS, context_before=_S, context_after=_S)
REPORTED_TEXT = _struct(value=_S, status=_S, evidence_ids=_IDS, missing_reason=_S)
REPORTED_NUMBER = _struct(value=_D, status=_S, evidence_ids=_IDS, missing_reason=_S)
OUTCOME = _struct(outcome_id=_S, experiment_id=_S, endpoint=REPORTED_TEXT, outcome_value=REPORTED_NUMBER, outcome_unit=REPORTED_TEXT)
CLAIM = _struct(claim_id=_S, subject_id=_S, predicate=_S, object_id=_S, experiment_id=_S, evidence_ids=_IDS)
FINDING = _struct(finding_id=_S, code=_S, record=_S)
TASK = _struct(task_id=_S, paper_id=_S, route=_S, evidence_ids=_IDS, task_checksum=_S)
ALL = {"block": BLOCK, "hit": HIT, "source": SOURCE, "evidence": EVIDENCE, "outcome": OUTCOME, "claim": CLAIM, "finding": FINDING, "task": TASK}


def export() -> dict[str, str]:
    """JSON of every schema by name."""
    return {name: schema.json() for name, schema in ALL.items()}
