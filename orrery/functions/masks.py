"""Atom masks: a small expression language compiled to a Column.

    :1-10,12    residues by number (from 1)          :LIG,ARG   residues by name
    @1-5        atoms by number (from 1)             @CA,N,H=   atoms by name; = and * match any ending, ? one letter
    :* @*       all                                  ! & |      not, and, or; ( ) group
    mask<:5     residues with an atom nearer than 5 Å to the mask; mask<@5 atoms; > for the others

Distances need a join, so masks that hold one are applied by select_atoms(); the others are plain filters that Catalyst pushes down.
Columns: resid and atom_id from 0, resname, atom_name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:([<>][:@]\s*[0-9.]+)|([!&|()])|([:@])\s*((?:[^\s<>!&|(),:@]+)(?:\s*,\s*[^\s<>!&|(),:@]+)*))")


@dataclass(frozen=True)
class Pick:
    """: or @ with its list."""

    kind: str
    items: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    """! & |, or a distance such as <:5.0."""

    name: str
    args: tuple


def parse(mask: str) -> Pick | Op:
    """The mask as a tree. Precedence, from loosest: |, &, !, distance."""
    tokens, at = [], 0
    mask = mask.rstrip()
    while at < len(mask):
        if not (m := _TOKEN.match(mask, at)):
            raise ValueError(f"mask {mask!r}: not understood from {mask[at:]!r}")
        tokens.append(m[1].replace(" ", "") if m[1] else m[2] or Pick(m[3], tuple(x.strip() for x in m[4].split(","))))
        at = m.end()

    def peek():
        return tokens[0] if tokens else None

    def either():
        left = both()
        while peek() == "|":
            tokens.pop(0)
            left = Op("|", (left, both()))
        return left

    def both():
        left = negated()
        while peek() == "&":
            tokens.pop(0)
            left = Op("&", (left, negated()))
        return left

    def negated():
        if peek() == "!":
            tokens.pop(0)
            return Op("!", (negated(),))
        return near()

    def near():
        out = single()
        while isinstance(peek(), str) and peek()[0] in "<>":
            t = tokens.pop(0)
            out = Op(t[:2], (out, float(t[2:])))
        return out

    def single():
        t = tokens.pop(0) if tokens else None
        if t == "(":
            out = either()
            if not tokens or tokens.pop(0) != ")":
                raise ValueError(f"mask {mask!r}: a parenthesis stays open")
            return out
        if isinstance(t, Pick):
            # :LIG@CA is both
            return Op("&", (t, tokens.pop(0))) if t.kind == ":" and isinstance(peek(), Pick) and peek().kind == "@" else t
        raise ValueError(f"mask {mask!r}: something is missing")

    out = either()
    if tokens:
        raise ValueError(f"mask {mask!r}: too much from {tokens[0]!r}")
    return out


def _pick(p: Pick) -> Column:
    number, name = ("resid", "resname") if p.kind == ":" else ("atom_id", "atom_name")
    names, out = [], F.lit(False)
    for item in p.items:
        if item == "*":
            return F.lit(True)
        if m := re.fullmatch(r"(\d+)(?:-(\d+))?", item):
            out = out | F.col(number).between(int(m[1]) - 1, int(m[2] or m[1]) - 1)
        elif re.search(r"[=*?]", item):
            pattern = "".join(".*" if c in "=*" else "." if c == "?" else re.escape(c) for c in item)
            out = out | F.col(name).rlike(f"^{pattern}$")
        else:
            names.append(item)
    return out | F.col(name).isin(names) if names else out


def has_distance(tree: Pick | Op) -> bool:
    return isinstance(tree, Op) and (tree.name[0] in "<>" or any(has_distance(a) for a in tree.args if not isinstance(a, float)))


def condition(mask: str | Pick | Op) -> Column:
    """The mask as a filter; it may hold no distance."""
    tree = parse(mask) if isinstance(mask, str) else mask
    if isinstance(tree, Pick):
        return _pick(tree)
    if tree.name == "!":
        return ~condition(tree.args[0])
    if tree.name in "&|":
        a, b = map(condition, tree.args)
        return a & b if tree.name == "&" else a | b
    raise ValueError("a mask with a distance needs select_atoms()")


def select_atoms(atoms: DataFrame, mask: str, keys: tuple[str, ...] = ("traj_id",)) -> DataFrame:
    """The atoms (with resid, atom_id, names, and x, y, z if the mask holds a distance) that the mask takes.

    A distance is an equi-join on cells of the cutoff's size: each selected atom meets the atoms of 27 cells, never all of them."""
    tree = parse(mask)
    if not has_distance(tree):
        return atoms.where(condition(tree))
    ids = [*keys, "atom_id"]

    def chosen(t: Pick | Op) -> DataFrame:
        if not has_distance(t):
            return atoms.where(condition(t)).select(*ids)
        if t.name == "!":
            return atoms.select(*ids).join(chosen(t.args[0]), ids, "left_anti")
        if t.name == "&":
            return chosen(t.args[0]).join(chosen(t.args[1]), ids, "left_semi")
        if t.name == "|":
            return chosen(t.args[0]).unionByName(chosen(t.args[1])).distinct()
        r = t.args[1]
        cell = lambda a: F.floor(F.col(a) / F.lit(r)).cast("int")
        seeds = atoms.join(chosen(t.args[0]), ids, "left_semi").select(*keys, *(F.col(a).alias(f"s{a}") for a in "xyz"), *(cell(a).alias(f"k{a}") for a in "xyz"))
        for a in "xyz":
            seeds = seeds.withColumn(f"k{a}", F.explode(F.sequence(F.col(f"k{a}") - 1, F.col(f"k{a}") + 1)))
        own = atoms.select(*keys, "atom_id", "resid", "x", "y", "z", *(cell(a).alias(f"k{a}") for a in "xyz"))
        d2 = sum(((F.col(a) - F.col(f"s{a}")) * (F.col(a) - F.col(f"s{a}")) for a in "yz"), (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")))
        near = own.join(seeds, [*keys, "kx", "ky", "kz"]).where(d2 < F.lit(r * r))
        if t.name[1] == ":":
            residues = near.select(*keys, "resid").distinct()
            return atoms.join(residues, [*keys, "resid"], "left_semi" if t.name[0] == "<" else "left_anti").select(*ids)
        return atoms.select(*ids).join(near.select(*ids).distinct(), ids, "left_semi" if t.name[0] == "<" else "left_anti")

    return atoms.join(chosen(tree), ids, "left_semi")
