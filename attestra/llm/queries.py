"""Queries and oracle SQL of the subpackage's operators."""

from __future__ import annotations

from attestra.llm.byte_cnn import op5_byte_cnn
from attestra.llm.edit_embedding import op9_edit_embedding
from attestra.llm.katz_backoff import op3_katz_backoff
from attestra.llm.level_packing import op7_level_packing
from attestra.llm.license_templates import op1_license_templates
from attestra.llm.line_windows import OP4_SQL, op4_line_windows
from attestra.llm.media_sniffing import op10_media_sniffing
from attestra.llm.piece_agenda import op8_piece_agenda
from attestra.llm.token_scan import op2_token_scan
from attestra.llm.universe_partition import OP6_SQL, op6_universe_partition

QUERIES = {
    "op1_license_templates": op1_license_templates,
    "op2_token_scan": op2_token_scan,
    "op3_katz_backoff": op3_katz_backoff,
    "op4_line_windows": op4_line_windows,
    "op5_byte_cnn": op5_byte_cnn,
    "op6_universe_partition": op6_universe_partition,
    "op7_level_packing": op7_level_packing,
    "op8_piece_agenda": op8_piece_agenda,
    "op9_edit_embedding": op9_edit_embedding,
    "op10_media_sniffing": op10_media_sniffing,
}

ORACLES: dict[str, str] = {"op4_line_windows": OP4_SQL, "op6_universe_partition": OP6_SQL}
