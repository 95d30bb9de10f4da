"""Functions over pairs of nodes: connectors compute relations, selectors keep pairs.

A parameter named ``x_s`` or ``x_t`` receives feature ``x`` of the source or target node, ``sources`` and ``targets`` the ids,
any other name a relation computed before. Functions receive Columns and return Columns, so Catalyst sees through them;
with ``vectorized=True`` they receive and return numpy arrays, batch by batch.
"""

from __future__ import annotations

import ast
import inspect
import textwrap
import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

#: Inputs that only a band join provides, and its output.
BAND_INPUTS = ("ft_feature_s", "ft_feature_t", "ftt")
BAND_OUTPUT = "ft_r"


@dataclass
class PairFunction:
    fn: Callable
    kind: str  # connector or selector
    outputs: tuple[str, ...]
    vectorized: bool = False
    types: Mapping[str, str] = field(default_factory=dict)
    indexing: bool = False  # a vectorized selector that returns reduced sources and targets instead of a mask

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(inspect.signature(self.fn).parameters)

    @property
    def name(self) -> str:
        return getattr(self.fn, "__name__", self.kind)

    def features(self) -> set[str]:
        return {p[:-2] for p in self.inputs if is_feature(p)}

    def relations(self) -> list[str]:
        return [p for p in self.inputs if not is_feature(p) and p not in ("sources", "targets", *BAND_INPUTS)]


def is_feature(parameter: str) -> bool:
    return parameter not in BAND_INPUTS and parameter.endswith(("_s", "_t"))


def _returned_names(fn: Callable) -> tuple[str, ...]:
    """The names in the last return statement of a function, from its syntax tree."""
    try:
        tree = ast.parse(textwrap.dedent(inspect.getsource(fn)))
    except (OSError, SyntaxError) as error:
        raise ValueError(f"name the outputs of {fn!r}: its source can't be read") from error
    found: tuple[str, ...] = ()
    for node in ast.walk(tree):
        if isinstance(node, ast.Return) and node.value is not None:
            parts = node.value.elts if isinstance(node.value, ast.Tuple) else [node.value]
            if not all(isinstance(p, ast.Name) for p in parts):
                raise ValueError(f"{getattr(fn, '__name__', fn)} must return plain names, or have its outputs named")
            found = tuple(p.id for p in parts)
    if not found:
        raise ValueError(f"{getattr(fn, '__name__', fn)} returns nothing")
    return found


def connector(outputs: Sequence[str] | None = None, vectorized: bool = False, types: Mapping[str, str] | None = None) -> Callable:
    """Declare a function that computes relations; ``types`` (SQL names, double by default) are for vectorized ones."""
    return lambda fn: PairFunction(fn, "connector", tuple(outputs or _returned_names(fn)), vectorized, types or {})


def selector(outputs: Sequence[str] = (), vectorized: bool = False, types: Mapping[str, str] | None = None) -> Callable:
    """Declare a function that returns a condition, or the condition followed by ``outputs``."""
    return lambda fn: PairFunction(fn, "selector", tuple(outputs), vectorized, types or {})


def as_functions(given: object, kind: str) -> list[PairFunction | str]:
    """Normalise what a caller passes: one function or many, declared or plain. The caller's list is not touched."""
    if given is None:
        return []
    if callable(given) or isinstance(given, (PairFunction, str)):
        given = [given]
    out: list[PairFunction | str] = []
    for fn in given:
        if isinstance(fn, (PairFunction, str)):
            out.append(fn)
        elif kind == "connector":
            out.append(PairFunction(fn, kind, _returned_names(fn)))
        else:
            params = inspect.signature(fn).parameters
            if "sources" in params and "targets" in params:  # numpy style: keeps sources and targets by indexing
                names = _returned_names(fn)
                if not {"sources", "targets"} <= set(names):
                    raise AssertionError(f"selector {fn.__name__} must return sources and targets")
                out.append(PairFunction(fn, kind, tuple(n for n in names if n not in ("sources", "targets")), True, indexing=True))
            else:
                out.append(PairFunction(fn, kind, ()))
    return out


def check_outputs(functions: Iterable[PairFunction], dtypes: Iterable[str], reserved: Iterable[str] = ()) -> None:
    """Output names must be unique (AssertionError); a type for an unknown output is only worth a warning."""
    seen: list[str] = list(reserved)
    for fn in functions:
        seen += fn.outputs
    twice = {n for n in seen if seen.count(n) > 1}
    assert not twice, f"relations computed more than once: {sorted(twice)}"
    wrong = [n for n in seen if n not in reserved and n.endswith(("_s", "_t"))]
    assert not wrong, f"relations must not end in _s or _t: {wrong}"
    for name in dtypes:
        if name not in seen:
            warnings.warn(f"no function computes {name!r}, its type is ignored", UserWarning, stacklevel=3)


def schedule(selectors: Sequence[PairFunction], connectors: Sequence[PairFunction], given: Iterable[str] = ()) -> list[PairFunction]:
    """The order of evaluation: selectors as listed, each pulling the connectors it needs; then the other connectors.

    So cheap selections come first and relations no selector needs are computed for survivors only. An input that nothing
    provides by then is a KeyError.
    """
    known, order = set(given), []
    maker = {name: fn for fn in connectors for name in fn.outputs}

    def pull(fn: PairFunction, pending: tuple[PairFunction, ...]) -> None:
        if any(fn is p for p in pending):
            raise KeyError(f"{fn.name} needs its own output")
        for name in fn.relations():
            if name not in known:
                if name not in maker:
                    raise KeyError(f"{fn.name} needs {name!r}, which isn't computed before")
                pull(maker[name], (*pending, fn))
        if not any(fn is o for o in order):
            order.append(fn)
            known.update(fn.outputs)

    for fn in selectors:
        pull(fn, ())
    for fn in connectors:
        if not any(fn is o for o in order):
            for name in fn.relations():
                if name not in known:
                    raise KeyError(f"{fn.name} needs {name!r}, which isn't computed before")
            pull(fn, ())
    return order
