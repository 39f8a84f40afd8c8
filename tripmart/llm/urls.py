"""URL filters: all glob rules at once by a bit-parallel automaton."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.llm.hashing import rows_of
from tripmart.llm.text import column, free_names

#: Between host and path of a canonical URL; no byte of UTF-8, and no wildcard spans it.
EDGE = 0xFF


@dataclass(frozen=True)
class Rule:
    """Globs of the host (with a dot in front) and of the path: `*` any characters, `?` one."""

    verdict: str
    host: str
    path: str
    name: str
    listed: bool = False

    @property
    def literals(self) -> int:
        return len((self.host + self.path).translate(str.maketrans("", "", "*?")))


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and a path with all that starts with it."""
    return Rule(verdict, f"*.{host}", f"{path}*", f"{host}{path}", listed=True)


# The listed rules.
LISTED = (
    prefix_rule("allow", "com", "/"),
    prefix_rule("block", "example.com", "/en/"),
    prefix_rule("allow", "www.example.com", "/en/"),
    prefix_rule("block", "net", "/es/"),
    prefix_rule("block", "net", "/fr/"),
)

# What is blocked on hosts that no listed rule covers, as host and path globs.
BLOCKED_HOSTS = ("*spam*", "*casino*", "*porn*", "*xxx*", "*phish*", "*malware*", "*torrent*", "*.ads.*", "*.adserver.*",
                 "*.doubleclick.*", "*-viagra*", "*payday-loan*", "*free-download*", "*.onion", "*.invalid", "*.localhost")
BLOCKED_PATHS = ("*/login*", "*/signin*", "*/logout*", "*/wp-admin/*", "*/wp-login*", "*/cgi-bin/*", "*/cart/*",
                 "*/checkout/*", "*.exe", "*.msi", "*.apk", "*.zip", "*.iso", "*.jpg", "*.jpeg", "*.png", "*.gif", "*.mp4",
                 "*.css", "*.js", "*/calendar/????-??-??*", "*/tag/*/page/*")
RULES = LISTED + tuple(Rule("block", h, "*", f"{h}/") for h in BLOCKED_HOSTS) + tuple(
    Rule("block", "*", p, p) for p in BLOCKED_PATHS)
#: What holds where no rule fits.
DEFAULT = "allow"


class Automaton:
    """Shift-And masks of many globs, packed into 64-bit words: one bit for the start and one for each literal or `?`.

    A step moves every state on by one place and keeps those that may take the byte, for all globs together; states
    before a `*` also stay on any byte but EDGE, states after a `?` on further bytes of the same character.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.patterns = [(r.host.encode(), r.path.encode()) for r in rules]
        n = sum(1 + sum(c != ord("*") for c in h + p) + 1 for h, p in self.patterns)
        self.words = max(1, -(-n // 64))
        moves = np.zeros((256, self.words * 64), bool)
        stays = np.zeros((256, self.words * 64), bool)
        inner = np.arange(256) != EDGE
        more = (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)
        starts, ends, at = [], [], 0
        for host, path in self.patterns:
            starts.append(at)
            for byte in [*host, EDGE, *path]:
                if byte == ord("*"):
                    stays[inner, at] = True
                    continue
                at += 1
                if byte == ord("?"):
                    moves[inner & ~more, at] = True
                    stays[more, at] = True
                else:
                    moves[byte, at] = True
            ends.append(at)
            at += 1
        self.moves, self.stays = self._packed(moves), self._packed(stays)
        first = np.zeros(self.words * 64, bool)
        first[starts] = True
        self.first = self._packed(first[None])[0]
        self.end_word, self.end_bit = np.array(ends) // 64, (np.array(ends) % 64).astype(np.uint64)

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def fits(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For strings of a byte array: which globs fit each of them whole (strings x globs)."""
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        state = np.repeat(self.first[None], len(sizes), axis=0)
        # strings stand by falling length, so those that go on are the first ones
        going = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), side="right")
        one, top = np.uint64(1), np.uint64(63)
        for place, n in enumerate(going.tolist()):
            live, byte = state[:n], data[begins[:n] + place]
            moved = live << one
            moved[:, 1:] |= live[:, :-1] >> top
            state[:n] = (moved & self.moves[byte]) | (live & self.stays[byte])
        out = np.empty((len(sizes), len(self.patterns)), bool)
        out[order] = (state[:, self.end_word] >> self.end_bit) & one
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: from the first `://` to `/`, `?`, `#` or the end, A-Z in lower case; path: on to `?`, `#` or the end.

    Both are empty for null and for a text without `://`.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host, path = (F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _judge(rules: tuple[Rule, ...]):
    # listed rules by the length of their text, then the others by their literal characters; earlier ones first
    rank = sorted(range(len(rules)), key=lambda i: (not rules[i].listed, -(
        len(rules[i].name) if rules[i].listed else rules[i].literals)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(tuple(rules[i] for i in rank))
        for rows in rows_of(batches, 1 << 20):
            hosts, paths = (rows.column(c).cast(pa.binary()).to_pylist() for c in ("_host", "_path"))
            urls = [b".%b%c%b" % (h, EDGE, p) for h, p in zip(hosts, paths)]
            sizes = np.array([len(u) for u in urls], np.int64)
            fits = automaton.fits(np.frombuffer(b"".join(urls), np.uint8), np.cumsum(sizes) - sizes, sizes)
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
            yield pa.record_batch([*rows.columns, pa.array([rank[i] if i >= 0 else None for i in best.tolist()], pa.int32())],
                                  names=[*rows.schema.names, "_rule"])
    return run


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """The columns of `pages` and `host`, `path`, `rule`, `glob`, `verdict` of each URL.

    The canonical URL is a dot, the host, an edge and the path, and all rules run over it at once. The longest listed
    rule that fits decides; `rule` is its text (null where none fits). Else the other rules decide, those with more
    literal characters first, earlier ones first among equals; else `default`. `glob` names the rule that decided, null
    for the default. URLs without `://` and null ones have an empty host and path, which rules may match as well.
    A very long URL takes one step per byte. Equal rows get equal results, no rows none. New columns whose names
    `pages` has get an underscore in front. The masks take 2 x 256 x (rule bytes / 64) words, in every task.
    """
    host, path, rule, glob, verdict = free_names(pages, "host", "path", "rule", "glob", "verdict")
    at_host, at_path = host_and_path(column(pages, url))
    own = [f"c{i}" for i in range(len(pages.columns))]
    parts = pages.select(*[column(pages, c).alias(o) for c, o in zip(pages.columns, own)],
                         at_host.alias("_host"), at_path.alias("_path"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    judged = parts.mapInArrow(_judge(rules), f"{schema}, _rule int")
    texts = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.listed).alias("listed"))
                      for r in rules])
    won = F.get(texts, F.col("_rule"))
    return judged.select(
        *[F.col(o).alias(c) for c, o in zip(pages.columns, own)], F.col("_host").alias(host), F.col("_path").alias(path),
        F.when(won["listed"], won["name"]).alias(rule), won["name"].alias(glob),
        F.coalesce(won["verdict"], F.lit(default)).alias(verdict))
