"""The few spots where Spark SQL and DuckDB SQL differ in the expressions of this library."""

from __future__ import annotations


class Dialect:
    name: str

    def q(self, name: str) -> str:
        raise NotImplementedError

    def div(self, a: str, b: str) -> str:
        """Integer division that truncates toward zero."""
        raise NotImplementedError

    def trunc(self, x: str) -> str:
        """A double cut toward zero, as a long."""
        raise NotImplementedError

    def xor(self, a: str, b: str) -> str:
        raise NotImplementedError

    def numbers(self, n: int | str, name: str = "n") -> str:
        """A subquery with one column 0 .. n-1."""
        raise NotImplementedError

    def array(self, values) -> str:
        raise NotImplementedError

    def at(self, array: str, place: str) -> str:
        """The element at a place counted from 0."""
        raise NotImplementedError

    def orbit(self, x0: str, y0: str, steps: int) -> str:
        """Steps of z -> z*z + (x0, y0) from 0 before |z| reaches 2, modulo steps."""
        raise NotImplementedError

    def half_up(self, x: str) -> str:
        """The nearest integer, halves upward."""
        return self.trunc(f"floor({x} + 0.5e0)")


class Spark(Dialect):
    name = "spark"

    def q(self, name):
        return f"`{name}`"

    def div(self, a, b):
        return f"(({a}) div ({b}))"

    def trunc(self, x):
        return f"cast({x} as bigint)"

    def xor(self, a, b):
        return f"(({a}) ^ ({b}))"

    def numbers(self, n, name="n"):
        return f"(SELECT id AS {name} FROM range({n}))"

    def array(self, values):
        return f"array({', '.join(map(str, values))})"

    def at(self, array, place):
        return f"get({array}, cast({place} as int))"

    def orbit(self, x0, y0, steps):
        step = f"if(a.x * a.x + a.y * a.y < 4, named_struct('x', a.x * a.x - a.y * a.y + {x0}, 'y', 2 * a.x * a.y + {y0}, 'n', a.n + 1), a)"
        return f"aggregate(sequence(1, {steps}), named_struct('x', 0e0, 'y', 0e0, 'n', 0), (a, k) -> {step}, a -> a.n % {steps})"


class Duck(Dialect):
    name = "duckdb"

    def q(self, name):
        return f'"{name}"'

    def div(self, a, b):
        return f"(({a}) // ({b}))"

    def trunc(self, x):
        return f"cast(trunc({x}) as bigint)"

    def xor(self, a, b):
        return f"xor({a}, {b})"

    def numbers(self, n, name="n"):
        return f"(SELECT range AS {name} FROM range({n}))"

    def array(self, values):
        return f"[{', '.join(map(str, values))}]"

    def at(self, array, place):
        return f"({array})[cast({place} as int) + 1]"

    def orbit(self, x0, y0, steps):
        step = f"CASE WHEN a.x * a.x + a.y * a.y < 4 THEN {{'x': a.x * a.x - a.y * a.y + {x0}, 'y': 2 * a.x * a.y + {y0}, 'n': a.n + 1}} ELSE a END"
        states = f"list_transform(range({steps}), lambda k: {{'x': 0e0, 'y': 0e0, 'n': 0}})"
        return f"(list_reduce({states}, lambda a, b: {step}, {{'x': 0e0, 'y': 0e0, 'n': 0}}).n % {steps})"


SPARK, DUCK = Spark(), Duck()
