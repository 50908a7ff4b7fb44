"""Column expressions over residue labels and paths of them; a label is a chain letter and a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAINS = "ABCD"


def make_label(chain: Column | str, number: Column | str) -> Column:
    return F.concat(F.col(chain) if isinstance(chain, str) else chain, (F.col(number) if isinstance(number, str) else number).cast("string"))


def chain_of(label: Column) -> Column:
    return F.substring(label, 1, 1)


def number_of(label: Column) -> Column:
    return F.substring(label, 2, 10).cast("int")


def shift_chain(chain: Column, by: Column | int, chains: str = CHAINS) -> Column:
    """The chain ``by`` places on, around the ring."""
    by = F.lit(by) if isinstance(by, int) else by
    at = F.pmod(F.instr(F.lit(chains), chain) - 1 + by, F.lit(len(chains))) + 1
    return F.substring(F.lit(chains), at.cast("int"), F.lit(1))


def relative_path(path: Column, chains: str = CHAINS) -> Column:
    """All chains turned so that the first node's is the first letter."""
    start = F.instr(F.lit(chains), chain_of(F.element_at(path, 1))) - 1
    return F.transform(path, lambda n: F.concat(shift_chain(chain_of(n), -start, chains), F.substring(n, 2, 10)))


def rotate_path(path: Column, from_chain: str = "A", to_chain: str = "D", low: int = 400, high: int = 710, chains: str = CHAINS) -> Column:
    """Each chain turned by one if some step goes from ``from_chain``, at a number outside [low, high], to ``to_chain``."""
    steps = F.arrays_zip(F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0))).alias("a"), F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0))).alias("b"))
    needs = F.exists(steps, lambda s: (chain_of(s["a"]) == from_chain) & (chain_of(s["b"]) == to_chain) & ((number_of(s["a"]) < low) | (number_of(s["a"]) > high)))
    return F.when(needs, F.transform(path, lambda n: F.concat(shift_chain(chain_of(n), 1, chains), F.substring(n, 2, 10)))).otherwise(path)


def parse_path(text: Column) -> Column:
    """Labels of a path written with ``-`` or spaces; a bare number is on the first chain, and other marks are left out."""
    parts = F.transform(F.split(text, r"[-\s]+"), lambda t: F.when(t.rlike(r"^\d+$"), F.concat(F.lit("A"), t)).otherwise(t))
    return F.filter(parts, lambda t: t.rlike(r"^[A-Za-z]\d+$"))


def format_path(path: Column) -> Column:
    return F.concat_ws("-", path)


def format_numbers(path: Column) -> Column:
    return F.concat_ws("-", F.transform(path, lambda n: F.substring(n, 2, 10)))


def cut_at_first(path: Column, numbers: list[int]) -> Column:
    """The path up to its first node with one of these numbers; the whole path where there is none."""
    hit = F.array_position(F.transform(path, lambda n: number_of(n).isin(numbers)), True)
    return F.when(hit > 0, F.slice(path, F.lit(1), hit.cast("int"))).otherwise(path)


def path_score(flow: Column, length: Column, exponent: float = 2.0) -> Column:
    return flow * F.pow(length, F.lit(exponent))


def number_overlap(a: Column, b: Column) -> Column:
    """Shared numbers over all numbers of two paths."""
    x, y = F.transform(a, number_of), F.transform(b, number_of)
    return F.when(F.size(F.array_union(x, y)) > 0, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def system_parts(name: Column) -> dict[str, Column]:
    """Structure and system of an artifact name: what stands before the first and before the second ``_``."""
    return {"structure": F.split_part(name, F.lit("_"), F.lit(1)), "system": F.concat_ws("_", F.slice(F.split(name, "_"), 1, 2))}


def expand_ranges(ranges: list[tuple[int, int]], singles: list[int]) -> Column:
    """Sorted distinct numbers of closed ranges and single ones."""
    parts = [F.sequence(F.lit(a), F.lit(b)) for a, b in ranges] + [F.array(*[F.lit(s) for s in singles])] * bool(singles)
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def pair_name(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit("-"), b)


def condition_label(structure: Column, names: dict[str, str], default: str | None = None) -> Column:
    """The condition of a structure; others keep their name, or have ``default`` if one is given."""
    out = F.lit(default) if default is not None else structure
    for key, value in names.items():
        out = F.when(structure == key, value).otherwise(out)
    return out


def step_score(equal: Column, d: Column) -> Column:
    """Substitution by distance, in steps: equal or under 5 gives 2, under 10 gives 1, under 15 -1, else or unknown -2."""
    return F.when(equal | (d < 5), 2).when(d < 10, 1).when(d < 15, -1).otherwise(-2)


def decay_score(equal: Column, d: Column, sigma: float = 8.0) -> Column:
    """Substitution that decays with distance: 1 if equal, 0 if the distance is unknown."""
    return F.when(equal, F.lit(1.0)).otherwise(F.coalesce(F.exp(-d / F.lit(sigma)), F.lit(0.0)))


def scale_to_cap(value: Column, largest: Column, cap: float = 99.99) -> Column:
    return F.when(largest > 0, value / largest * cap).otherwise(F.lit(0.0))


def scale_symmetric(value: Column, largest: Column, cap: float = 99.99) -> Column:
    """To [-cap, cap] by the largest absolute value."""
    return F.when(largest > 0, F.greatest(F.lit(-cap), F.least(F.lit(cap), value / largest * cap))).otherwise(F.lit(0.0))
