"""Seeded random graphs over const, pack and fail, for property tests."""

from __future__ import annotations

_MASK = (1 << 64) - 1


class SplitMix64:
    def __init__(self, seed: int):
        self.state = seed & _MASK

    def next(self) -> int:
        #: The constants of SplitMix64.
        self.state = (self.state + 0x9E3779B97F4A7C15) & _MASK
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        return z ^ (z >> 31)

    def draw(self, n: int) -> int:
        return self.next() % n


def generate(seed: int) -> dict:
    """Two to six nodes: n0 a constant, others packs of earlier nodes or, one time in ten, failures; all exported."""
    rng = SplitMix64(seed)
    nodes, edges = [], []
    for i in range(2 + rng.draw(5)):
        fails = rng.draw(10) == 0 and i > 0  # drawn for every node
        if i == 0:
            nodes.append({"id": "n0", "routine": "vec/const@1", "params": {"value": rng.draw(1000)}})
        elif fails:
            #: The params of a failing node.
            nodes.append({"id": f"n{i}", "routine": "vec/fail@1", "params": {"code": "vec/planned", "message": "planned failure", "retryable": False}})
            edges.append({"kind": "data", "from": f"n{rng.draw(i)}", "to": f"n{i}.in"})
        else:
            nodes.append({"id": f"n{i}", "routine": "vec/pack@1"})
            count = 1 + rng.draw(min(i, 3))
            edges += [{"kind": "data", "from": f"n{rng.draw(i)}", "to": f"n{i}.a{k}"} for k in range(count)]
    return {"name": f"gen{seed}", "nodes": nodes, "edges": edges, "exports": [{"name": f"out{i}", "from": n["id"]} for i, n in enumerate(nodes)]}
