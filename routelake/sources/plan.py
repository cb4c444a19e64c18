"""Repack plans as text: which tensors of a block are permuted, and how."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from . import open_file, put_file

#: Fixed value: the first line of the text form.
HEAD = "pmxplan 1"
_LAYER = re.compile(r"layer (\d+) experts (\d+) speedup ([\d.]+) requests ([\d.]+) -> ([\d.]+)$")


class PlanError(ValueError):
    """A plan doesn't parse, or a layer's order is not a permutation."""


@dataclass
class Layer:
    block: int
    tensors: list[str]
    perm: list[int]
    speedup: float = 1.0
    requests_before: float = 0.0
    requests_after: float = 0.0


@dataclass
class Plan:
    model: str
    trace: str
    layers: list[Layer] = field(default_factory=list)

    def check(self) -> Plan:
        for x in self.layers:
            if not x.tensors:
                raise PlanError(f"layer {x.block} lists no tensors")
            if sorted(x.perm) != list(range(len(x.perm))):
                raise PlanError(f"layer {x.block} is not a permutation")
        return self

    def text(self) -> str:
        out = [HEAD, f"model {self.model}", f"trace {self.trace}"]
        for x in self.layers:
            out += ["", f"layer {x.block} experts {len(x.perm)} speedup {x.speedup:.4f} requests {x.requests_before:.2f} -> {x.requests_after:.2f}",
                "tensors " + ",".join(x.tensors), "perm " + ",".join(map(str, x.perm))]
        return "\n".join(out) + "\n"


def parse(text: str) -> Plan:
    """A plan from its text; blank lines and those from # are skipped, unknown ones are errors."""
    lines = [x.strip() for x in text.splitlines()]
    lines = [x for x in lines if x and not x.startswith("#")]
    if not lines or lines[0] != HEAD:
        raise PlanError("not a plan")
    plan, counts = Plan("", ""), []
    for line in lines[1:]:
        key, _, rest = line.partition(" ")
        if key in ("model", "trace"):
            setattr(plan, key, rest)
        elif key == "layer":
            m = _LAYER.match(line)
            if not m:
                raise PlanError(f"not a layer: {line!r}")
            plan.layers.append(Layer(int(m[1]), [], [], float(m[3]), float(m[4]), float(m[5])))
            counts.append(int(m[2]))
        elif key in ("tensors", "perm") and plan.layers:
            try:
                values = [x for x in rest.split(",") if x]
                setattr(plan.layers[-1], key, values if key == "tensors" else list(map(int, values)))
            except ValueError as e:
                raise PlanError(f"not a permutation: {line!r}") from e
        else:
            raise PlanError(f"unknown line: {line!r}")
    for x, n in zip(plan.layers, counts, strict=True):
        if len(x.perm) != n:
            raise PlanError(f"layer {x.block} has {len(x.perm)} of {n} experts")
    return plan.check()


def write(plan: Plan, path: str) -> None:
    put_file(path, plan.check().text().encode())


def read(path: str) -> Plan:
    f, _ = open_file(path)
    with f:
        return parse(f.read().decode())
