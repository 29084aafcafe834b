"""Word list numbers: counters by abstract list, as a fold over a document's paragraphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

ROMANS = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


UNNUMBERED = ("bullet", "none")


def _roman(n: int) -> str:
    out = ""
    for value, sign in ROMANS:
        out, n = out + sign * (n // value), n % value
    return out


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def counter_text(n: int, fmt: str) -> str:
    if n <= 0:
        return str(n)
    made = {"decimalZero": f"{n:02d}", "lowerLetter": _letters(n), "upperLetter": _letters(n).upper(), "lowerRoman": _roman(n), "upperRoman": _roman(n).upper()}
    return made.get(fmt, str(n))


def numbers(paragraphs: DataFrame, levels: DataFrame) -> DataFrame:
    """(doc_id, par_no, number, list_format): paragraphs (doc_id, par_no, num_id, ilvl) numbered by levels (doc_id, num_id, abstract_id, ilvl, fmt,
    lvl_text, start, restart, start_override); bullets have none. The definitions travel with their document."""

    def run(key: tuple, pars: pd.DataFrame, defs: pd.DataFrame) -> pd.DataFrame:
        known = {(d.num_id, int(d.ilvl)): d for d in defs.itertuples()}
        counters: dict = {}
        begun: set = set()
        rows = []
        for p in pars.sort_values("par_no").itertuples():
            d = known.get((p.num_id, int(p.ilvl)))
            if d is None:
                rows.append((key[0], p.par_no, None, None))
                continue
            state = counters.setdefault(d.abstract_id, {})
            if p.num_id not in begun:
                begun.add(p.num_id)
                for (num, lvl), x in known.items():
                    if num == p.num_id and x.start_override == x.start_override and x.start_override is not None:
                        state[lvl] = int(x.start_override) - 1
            lvl = int(p.ilvl)
            deeper = [k for k in state if k > lvl and not (known.get((p.num_id, k)) is not None and known[(p.num_id, k)].restart == 0)]
            if d.fmt not in UNNUMBERED:
                state[lvl] = state[lvl] + 1 if lvl in state else int(d.start)
            for k in deeper:
                state.pop(k)
            if d.fmt in UNNUMBERED:
                rows.append((key[0], p.par_no, None, d.fmt))
                continue
            text = d.lvl_text
            for k in range(9, 0, -1):
                x = known.get((p.num_id, k - 1))
                if f"%{k}" in text:
                    # a level without a definition counts as decimal, from 1
                    text = text.replace(f"%{k}", counter_text(int(state.get(k - 1, 1 if x is None else x.start)), "decimal" if x is None else x.fmt))
            rows.append((key[0], p.par_no, text.strip(), d.fmt))
        return pd.DataFrame(rows, columns=["doc_id", "par_no", "number", "list_format"])

    return paragraphs.groupBy("doc_id").cogroup(levels.groupBy("doc_id")).applyInPandas(run, "doc_id string, par_no long, number string, list_format string")
