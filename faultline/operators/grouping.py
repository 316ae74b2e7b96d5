"""Operators that go through rows in order: template mining, grouping of failures, near-duplicate logs.

They are sequential by definition, so a group is one task and is held whole: a launch's failures, an item's logs, which are
bounded by what one test run does. A project's lines aren't, so they are mined in shards, whose templates are mined again.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH, SIMILARITY, MAX_CHILDREN, MAX_CLUSTERS = 4, 0.4, 100, 4096
WILDCARD = "<*>"


class TemplateTree:
    """A fixed-depth prefix tree of log templates: lines go down by length and leading tokens, then join the most similar
    template of the leaf, whose differing tokens become wildcards."""

    def __init__(self):
        self.leaves: dict[tuple, list[int]] = {}
        self.children: dict[tuple, set[str]] = {}
        self.templates: OrderedDict[int, list[str]] = OrderedDict()
        self.next = 0

    def _leaf(self, tokens: list[str], grow: bool) -> tuple:
        path: tuple = (len(tokens),)
        for token in tokens[: DEPTH - 3]:  # besides the root, the length and the leaf
            known = self.children.setdefault(path, set())
            if any(c.isdigit() for c in token):
                token = WILDCARD
            if token not in known:
                if grow and len(known) < MAX_CHILDREN:
                    known.add(token)
                else:
                    token = WILDCARD
            path = (*path, token)
        return path

    def _best(self, tokens: list[str], leaf: tuple) -> tuple[int | None, float]:
        """The most similar template of a leaf; of equals that of most wildcards."""
        best, score = None, (-1.0, -1)
        for c in self.leaves.get(leaf, ()):
            if c in self.templates:
                t = self.templates[c]
                found = (sum(a == b != WILDCARD for a, b in zip(t, tokens, strict=True)) / max(len(tokens), 1), t.count(WILDCARD))
                if found > score:
                    best, score = c, found
        return best, score[0]

    @staticmethod
    def tokens(line: str) -> list[str]:
        return line.replace("_", " ").replace("|", " ").split()

    def add(self, line: str) -> tuple[int, str]:
        tokens = self.tokens(line)
        leaf = self._leaf(tokens, True)
        best, score = self._best(tokens, leaf)
        if best is None or score < SIMILARITY and self.templates[best] != tokens:
            best, self.next = self.next, self.next + 1
            self.templates[best] = tokens
            # of templates that are gone a leaf keeps no trace
            self.leaves[leaf] = [*(c for c in self.leaves.get(leaf, ()) if c in self.templates), best]
            if len(self.templates) > MAX_CLUSTERS:
                self.templates.popitem(last=False)
        else:
            self.templates[best] = [a if a == b else WILDCARD for a, b in zip(self.templates[best], tokens, strict=True)]
            self.templates.move_to_end(best)
        return best, " ".join(self.templates[best])

    def match(self, line: str) -> str | None:
        """The template a line belongs to, without learning from it."""
        tokens = self.tokens(line)
        best, score = self._best(tokens, self._leaf(tokens, False))
        fits = best is not None and all(a in (b, WILDCARD) for a, b in zip(self.templates[best], tokens, strict=True))
        return " ".join(self.templates[best]) if fits or best is not None and score >= SIMILARITY else None

    @classmethod
    def of(cls, patterns: list[str]) -> TemplateTree:
        """A tree that holds stored templates again, each as it was, most frequent first."""
        tree = cls()
        for p in patterns:
            tokens = tree.tokens(p)
            tree.leaves.setdefault(tree._leaf(tokens, True), []).append(tree.next)
            tree.templates[tree.next] = tokens
            tree.next += 1
        return tree


def mine_templates(lines: DataFrame, group: str, order: list[str], line: str, shards: int = 16) -> DataFrame:
    """(group, template, template_hash, n): the templates of each group's lines and how many lines each took.

    A group's lines are dealt by hash of all but the line over shards that are mined on their own, in order; their templates, of
    which there are at most ``MAX_CLUSTERS`` a shard, are mined again as lines, most frequent first.
    """

    def mined(key, texts: Iterator[tuple[str, int]]) -> pd.DataFrame:
        tree, counts = TemplateTree(), {}
        for text, weight in texts:
            if isinstance(text, str) and text.strip():
                c, _ = tree.add(text)
                counts[c] = counts.get(c, 0) + weight
                if len(counts) > 2 * MAX_CLUSTERS:
                    counts = {c: counts[c] for c in tree.templates}
        patterns = {c: " ".join(t) for c, t in tree.templates.items()}
        rows = [(key, p, hashlib.md5(p.encode()).hexdigest(), counts[c]) for c, p in patterns.items()]
        out = pd.DataFrame(rows, columns=[group, "template", "template_hash", "n"])
        return out.groupby([group, "template", "template_hash"], as_index=False)["n"].sum() if len(out) else out

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a task's shards one after the other, each in order: a batch of lines and one tree are held
        lines_ = ((g, text) for frame in frames for g, text in zip(zip(frame["__shard"], frame[group], strict=True), frame[line], strict=True))
        for (_, key), some in groupby(lines_, lambda x: x[0]):
            yield mined(key, ((text, 1) for _, text in some))

    def second(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "template"], ascending=[False, True])
        return mined(frame[group].iloc[0], zip(frame["template"], frame["n"].astype(int), strict=True))

    names = [o for o in order if o not in (group, line)]
    schema = f"{group} {lines.schema[group].dataType.simpleString()}, template string, template_hash string, n long"
    dealt = lines.select(group, *names, line).withColumn("__shard", F.pmod(F.xxhash64(names[0]) if names else F.xxhash64(line), F.lit(shards)))
    sorted_ = dealt.repartition(group, "__shard").sortWithinPartitions(group, "__shard", *[F.asc_nulls_last(o) for o in order]).select(F.col(group).cast("string").alias(group), "__shard", line)
    # as text, as pandas makes floats of whole numbers among which are nulls
    parts = sorted_.mapInPandas(first, f"{group} string, template string, template_hash string, n long").withColumn(group, F.col(group).cast(lines.schema[group].dataType))
    return parts.groupBy(group, "template", "template_hash").agg(F.sum("n").alias("n")).groupBy(group).applyInPandas(second, schema)


class Groups:
    """Groups of failures with their normalised means side by side."""

    def __init__(self, width: int):
        self.items: list[list[int]] = []
        self.templates: list[set] = []
        self.means = np.zeros((0, width), np.float32)

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        n = float(np.linalg.norm(v))
        return v.astype(np.float32) if n < 1e-12 else (v / n).astype(np.float32)

    def new(self, items: list[int], vectors: np.ndarray, templates: set) -> None:
        self.items.append(items)
        self.templates.append(templates)
        self.means = np.concatenate((self.means, self.unit(vectors.mean(0))[None]))

    def add(self, k: int, item: int, v: np.ndarray, templates: set) -> None:
        n = len(self.items[k])
        self.means[k] = self.unit((self.means[k] * n + v) / (n + 1))
        self.items[k].append(item)
        self.templates[k] |= templates

    def nearest(self, v: np.ndarray, least: float) -> int | None:
        """The group of the greatest cosine of ``least`` or more, the later of equals."""
        if not self.items:
            return None
        cosines = self.means @ v
        k = len(cosines) - 1 - int(cosines[::-1].argmax())
        return k if cosines[k] >= least else None


def group_failures(items: DataFrame, least: float = 0.83, jaccard: float = 0.5) -> DataFrame:
    """(project_id, launch_id, item_id, group_no) of (project_id, launch_id, item_id, exception_fp, emb, template_ids).

    A launch's items of one fingerprint are a group. Items without one (0) join, in order of id, the group whose running mean is
    nearest at a cosine of ``least`` or more (the later of equals), or found their own. Then, in one pass, a group joins the first
    earlier one whose mean is as near and whose templates overlap by ``jaccard``. A null vector is near to nothing.
    """

    def grouped(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item_id")
        width = max((len(e) for e in frame["emb"] if e is not None), default=1)
        vectors = {i: np.zeros(width, np.float32) if e is None else np.asarray(e, np.float32) for i, e in zip(frame["item_id"], frame["emb"], strict=True)}
        templates = {i: set(np.asarray(t).tolist()) if t is not None else set() for i, t in zip(frame["item_id"], frame["template_ids"], strict=True)}
        groups = Groups(width)
        known = frame[frame["exception_fp"] != 0]
        for _, members in known.groupby("exception_fp", sort=True)["item_id"]:
            ids = members.tolist()
            groups.new(ids, np.stack([vectors[i] for i in ids]), set().union(*(templates[i] for i in ids)))
        for i in frame[frame["exception_fp"] == 0]["item_id"]:
            k = groups.nearest(vectors[i], least)
            if k is None:
                groups.new([i], vectors[i][None], set(templates[i]))
            else:
                groups.add(k, i, vectors[i], templates[i])
        merged = Groups(width)
        for ids, mean, own in zip(groups.items, groups.means, groups.templates, strict=True):
            near = np.flatnonzero(merged.means @ mean >= least) if merged.items else ()
            k = next((k for k in near if merged.templates[k] | own and len(merged.templates[k] & own) >= jaccard * len(merged.templates[k] | own)), None)
            if k is None:
                merged.items.append(list(ids))
                merged.templates.append(set(own))
                merged.means = np.concatenate((merged.means, mean[None]))
            else:
                for i in ids:
                    merged.add(k, i, vectors[i], templates[i])
        first = frame.iloc[0]
        rows = [(first["project_id"], first["launch_id"], i, n) for n, ids in enumerate(merged.items) for i in ids]
        return pd.DataFrame(rows, columns=["project_id", "launch_id", "item_id", "group_no"])

    columns = ("project_id", "launch_id", "item_id", "exception_fp", "emb", "template_ids")
    return items.select(*columns).groupBy("project_id", "launch_id").applyInPandas(grouped, "project_id long, launch_id long, item_id long, group_no int")


def term_vectors(texts: list[str], idf: bool) -> np.ndarray | None:
    """Unit vectors of words and word pairs, weighted by smooth inverse document frequency if asked; None without any word."""
    words = [re.findall(r"\b\w+\b", t) for t in texts]
    grams = [[*w, *zip(w, w[1:], strict=False)] for w in words]
    names = {g: k for k, g in enumerate(dict.fromkeys(x for g in grams for x in g))}
    if not names:
        return None
    m = np.zeros((len(texts), len(names)))
    for i, g in enumerate(grams):
        for x in g:
            m[i, names[x]] += 1
    if idf:
        m *= np.log((1 + len(m)) / (1 + (m > 0).sum(0))) + 1
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def drop_near_duplicates(messages: list[str], least: float = 0.95) -> list[int]:
    """The places that stay. A message names the last one that is as near to it, itself if none is; whom a message names that no other
    named before, stays, and so does the last message. Without any word, all stay."""
    m = term_vectors(messages, True)
    if m is None:
        return list(range(len(messages)))
    n = len(messages)
    near = np.triu(m @ m.T >= least - 1e-12) | np.eye(n, dtype=bool)
    named = n - 1 - near[:, ::-1].argmax(1)
    stays = np.zeros(n, bool)
    for i, last in enumerate(named[:-1].tolist()):
        stays[last] |= not stays[i]
    stays[-1] = True
    return np.flatnonzero(stays).tolist()


def unique_logs(logs: DataFrame, least: float = 0.95) -> DataFrame:
    """(item_id, pos) of the logs that stay in each item."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        return frame.iloc[drop_near_duplicates(frame["message"].fillna("").tolist(), least)][["item_id", "pos"]]

    return logs.select("item_id", "pos", "message").groupBy("item_id").applyInPandas(run, "item_id long, pos long")
