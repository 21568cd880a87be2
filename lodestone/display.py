"""Results as text for a terminal, and logging."""

from __future__ import annotations

import logging
import sys
import time
from collections.abc import Mapping, Sequence
from pathlib import Path

LOGGER = logging.getLogger("lodestone")
_FORMAT = "[%(asctime)s] %(levelname)s: %(message)s"


def number(x: object, digits: int = 4) -> str:
    return "-" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else f"{x:,}" if isinstance(x, int) and not isinstance(x, bool) else str(x)


def table(rows: Sequence[Mapping], columns: Sequence[str] | None = None) -> str:
    """Rows as aligned columns, numbers to the right."""
    columns = columns or (list(rows[0]) if rows else [])
    cells = [[number(r.get(c)) for c in columns] for r in rows]
    width = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    text = [i for i, c in enumerate(columns) if any(isinstance(r.get(c), str) for r in rows)]
    line = lambda xs: "  ".join(x.ljust(w) if i in text else x.rjust(w) for i, (x, w) in enumerate(zip(xs, width))).rstrip()
    return "\n".join([line(columns), "  ".join("-" * w for w in width), *map(line, cells)])


def panel(title: str, values: Mapping) -> str:
    """A title and its values, one a line."""
    width = max(map(len, values), default=0)
    return "\n".join([title, "-" * len(title), *(f"{k.ljust(width)}  {number(v)}" for k, v in values.items())])


def reliability_plot(bins: Sequence[Mapping], width: int = 50) -> str:
    """A bar of the mean truth of each bin of predictions, with a mark where the mean prediction is."""
    out = []
    for b in sorted(bins, key=lambda b: b["bin"]):
        bar = list("#" * round(b["mean_truth"] * width) + " " * (width - round(b["mean_truth"] * width)))
        at = min(width - 1, max(0, round(b["mean_predicted"] * width)))
        bar[at] = "|"
        out.append(f"{b['bin']:>3} {''.join(bar[:width])} {b['mean_truth']:.3f} ({b['n']:,})")
    return "\n".join(out)


def histogram(counts: Mapping, width: int = 50) -> str:
    """Counts as bars, the largest over the whole width."""
    top, name = max(counts.values(), default=0) or 1, max((len(str(k)) for k in counts), default=0)
    return "\n".join(f"{str(k).ljust(name)} {'#' * round(v / top * width)} {v:,}" for k, v in counts.items())


def logger(folder: str | None = None) -> logging.Logger:
    """The package's logger: to standard error, and to ``run_<time>.log`` in ``folder``; earlier handlers go."""
    for h in list(LOGGER.handlers):
        LOGGER.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if folder is not None:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder) / f"run_{time.strftime('%Y%m%d_%H%M%S')}.log", mode="w"))
    for h in handlers:
        h.setFormatter(logging.Formatter(_FORMAT))
        LOGGER.addHandler(h)
    LOGGER.setLevel(logging.INFO)
    return LOGGER
