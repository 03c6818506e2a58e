"""Nothing that a model is fitted from stands in a table."""

import importlib
import re

import pandas as pd

RUN = 6
WORDS = re.compile(r"[^\W_]+")
COLUMNS = {"documents": ["text"], "files": ["text"], "arch": ["ko", "en"], "findings": ["message"], "rule_defs": ["message"], "eval_items": ["text"], "redis": ["message"]}


def runs(text):
    ws = WORDS.findall(text.lower())
    return {tuple(ws[i : i + RUN]) for i in range(len(ws) - RUN + 1)}


def seed_texts():
    for name in ("seeds", "residue_seeds", "markup_seeds"):
        m = importlib.import_module(f"codelode.llm.{name}")
        for k, v in vars(m).items():
            if k.isupper() and not k.startswith("PUBLIC_"):  # fixed texts of public software, which tables may hold too
                yield f"{name}.{k}", v if isinstance(v, str) else "\n".join(map(str, v))


def test_no_seed_shares_six_words_with_a_table(sf):
    seen = set()
    for table, columns in COLUMNS.items():
        d = pd.read_parquet(f"{sf}/{table}.parquet", columns=columns)
        for c in columns:
            for t in d[c].dropna().unique():
                seen |= runs(t)
    for name, text in seed_texts():
        assert not runs(text) & seen, (name, sorted(runs(text) & seen)[:5])
