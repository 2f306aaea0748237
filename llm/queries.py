"""Every query of this package with its SQL (None where SQL cannot express it)."""

from __future__ import annotations

from llm import (
    alignment,
    chat,
    decontaminate,
    html_text,
    line_dedup,
    minhash,
    packing,
    ppm,
    prefix_trie,
    quality,
    repeats,
    sharding,
    token_files,
)

QUERIES = {
    **line_dedup.QUERIES,
    **html_text.QUERIES,
    **ppm.QUERIES,
    **decontaminate.QUERIES,
    **quality.QUERIES,
    **packing.QUERIES,
    **token_files.QUERIES,
    **chat.QUERIES,
    **sharding.QUERIES,
    **minhash.QUERIES,
    **prefix_trie.QUERIES,
    **alignment.QUERIES,
    **repeats.QUERIES,
}
