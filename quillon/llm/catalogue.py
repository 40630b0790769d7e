"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ["license_scan", "fingerprints", "sstable", "toxicity", "simhash", "quality", "line_dedup", "mixing", "byte_bpe", "chat", "chat_repair", "exact_dedup", "collocations"]


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE_SQL")
