"""The queries of the nine problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import p1, p2, p3, p4, p5, p6, p7, p8, p9

QUERIES = {
    f.__name__: f
    for f in (
        p1.p1_found,
        p2.p2_found,
        p3.p3_found,
        p4.p4_found,
        p4.p4_pieces,
        p5.p5_found,
        p5.p5_rates,
        p6.p6_found,
        p6.p6_consistent,
        p7.p7_containers,
        p7.p7_fill,
        p8.p8_mix,
        p8.p8_shares,
        p9.p9_found,
        p9.p9_subjects,
        p9.p9_composition,
    )
}

SQL = {
    "p4_found": """
        SELECT 'documents' AS src_table, doc_id AS row_id FROM documents WHERE length(text) > 1200
        UNION ALL
        SELECT 'translations' AS src_table, tr_id AS row_id FROM translations WHERE length(t) > 1200
    """,
}
