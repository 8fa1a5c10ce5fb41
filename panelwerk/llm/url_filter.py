"""URL filters by a bit-parallel wildcard automaton.

All rules are globs over a canonical URL: a dot, the host in lower case, a separator, the path. Their symbols are packed one
after another into the bits of a few 64-bit words. A step of the Shift-And automaton moves every pattern at once: each
active bit goes on if the next symbol matches, and stays if a ``*`` stands there. Carries go from word to word, so a
pattern may be longer than 64. A batch of URLs takes its steps together, one character position at a time.

``*`` stands for any run of characters other than the separator, ``?`` for one such character.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and the verdict of the globs on these;
repeated urls are judged row by row; extra columns are kept by ``judge_urls``, those named like its own under
another name. Urls are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import free_name, set_aside, table

SEPARATOR = "\n"
#: (verdict, host, path): production rules; they hold for the host and its subdomains, the longest wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Globs over host and path that block a url which no rule fits.
BLOCKED = [
    ("*casino*", "*"), ("*pills*", "*"), ("*viagra*", "*"), ("*free-bets*", "*"), ("*poker*", "*"), ("*adult*", "*"),
    ("*porn*", "*"), ("*.xxx", "*"), ("*spam*", "*"), ("*ads-track*", "*"), ("*.ads.*", "*"), ("*.adserver.*", "*"),
    ("*doubleclick*", "*"), ("*", "*/wp-login*"), ("*", "*/cgi-bin/*"), ("*", "*/ads/*"), ("*", "*/phishing*"), ("*", "*.exe"),
]


class Automaton:
    """Which of the globs match each text of a batch."""

    def __init__(self, globs: list[str]):
        symbols = sorted({ord(c) for g in globs for c in g if c not in "*?"})
        self.symbols = np.array(symbols, dtype=np.uint32)
        classes = len(symbols) + 1  # the last: any other character
        separator = symbols.index(ord(SEPARATOR)) if ord(SEPARATOR) in symbols else -1
        start, accept, stays, moves, at = [], [], [], [[] for _ in range(classes)], 0
        for glob in globs:
            start.append(at)
            for c in glob:
                if c == "*":
                    stays.append(at)
                    continue
                at += 1
                for k in [x for x in range(classes) if x != separator] if c == "?" else [symbols.index(ord(c))]:
                    moves[k].append(at)
            accept.append(at)
            at += 1
        words = -(-at // 64)
        pack = lambda bits: self._pack(bits, words)
        self.start, self.accept = pack(start), accept
        self.moves = np.array([pack(m) for m in moves])
        self.stays = np.array([pack([] if k == separator else stays) for k in range(classes)])

    @staticmethod
    def _pack(bits: list[int], words: int) -> np.ndarray:
        out = np.zeros(words, np.uint64)
        for b in bits:
            out[b // 64] |= np.uint64(1 << b % 64)
        return out

    def match(self, texts: list[str]) -> np.ndarray:
        """A boolean row of len(globs) for each text."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        found = np.minimum(np.searchsorted(self.symbols, points), len(self.symbols) - 1)
        kinds = np.where(self.symbols[found] == points, found, len(self.symbols)) if len(points) else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        state = np.tile(self.start, (len(texts), 1))
        for j in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -j, side="left"))  # texts longer than j
            now, kind = state[:active], kinds[first[:active] + j]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = moved & self.moves[kind] | now & self.stays[kind]
        out = np.zeros((len(texts), len(self.accept)), bool)
        for k, b in enumerate(self.accept):
            out[order, k] = state[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: list = RULES, blocked: list = BLOCKED, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    names = [h + p for _, h, p in rules]
    ranked = sorted(range(len(rules)), key=lambda k: (len(names[k]), -k))
    globs = [f"*.{h}{SEPARATOR}{p}*" for _, h, p in rules] + [f"{h}{SEPARATOR}{p}" for h, p in blocked]

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(globs)
        for hosts, paths in batches:
            hit = automaton.match(["." + h.replace(SEPARATOR, " ") + SEPARATOR + p.replace(SEPARATOR, " ") for h, p in zip(hosts, paths, strict=True)])
            rule = np.full(len(hosts), None, dtype=object)
            verdict = np.where(hit[:, len(rules) :].any(axis=1), "block", "allow").astype(object)
            for k in ranked:
                rule[hit[:, k]], verdict[hit[:, k]] = names[k], rules[k][0]
            yield pd.DataFrame({"rule": rule, "verdict": verdict})

    python_workers(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    rows = set_aside(pages, "host", "path", "rule", "verdict")
    both = free_name(rows, "judged")
    judged = rows.withColumns({"host": host, "path": path}).withColumn(both, judge("host", "path"))
    return judged.withColumns({"rule": F.col(both)["rule"], "verdict": F.col(both)["verdict"]}).drop(both)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    like = lambda glob, what: "TRUE" if glob == "*" else f"{what} LIKE '{glob.replace('*', '%')}'"
    blocked = " OR ".join(f"({like(h, dotted)} AND {like(p, 'path')})" for h, p in BLOCKED for dotted in ["('.' || host)"])
    fits = "\n".join(
        f"    WHEN ('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT *, CASE
{fits}
    END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE WHEN {blocked} THEN 'block' ELSE 'allow' END END AS verdict FROM f
"""


#: The same rows in DuckDB's SQL.
ORACLE_SQL = _sql()
