"""Registered queries of the text problems."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quantiles", "credentials", "mojibake", "lookalike", "packing", "leakage", "sentences")


def _merged(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(import_module(f"skerry.llm.{m}"), name))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
