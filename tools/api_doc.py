"""Write docs/API.md: public functions of the library with signatures and the
first line of their docstrings.

Usage: python -m tools.api_doc
"""

from __future__ import annotations

import importlib
import inspect
import os
import sys

MODULES = ["seqwise.sources.events", "seqwise.sources.sinks", "seqwise.functions.columns",
           "seqwise.operators.windows", "seqwise.operators.labels", "seqwise.operators.sequences",
           "seqwise.operators.frames", "seqwise.operators.aggregates", "seqwise.operators.quality",
           "seqwise.operators.vocab", "seqwise.operators.sampling", "seqwise.operators.store",
           "seqwise.operators.scoring", "seqwise.operators.metrics", "seqwise.operators.feedback",
           "seqwise.operators.training", "seqwise.streaming.feed", "seqwise.streaming.ingest",
           "seqwise.streaming.features", "seqwise.streaming.stateful", "seqwise.streaming.lookup",
           "seqwise.sources.compaction", "seqwise.operators.quantiles", "seqwise.operators.sketches",
           "seqwise.session"]


def main() -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    out = ["# API reference", "", "Generated by `python -m tools.api_doc`: public functions and classes,",
           "their signatures and the first line of their docstrings.", ""]
    for name in MODULES:
        mod = importlib.import_module(name)
        doc = (inspect.getdoc(mod) or "").splitlines()
        out += [f"## `{name}`", "", doc[0] if doc else "", ""]
        for attr, obj in sorted(vars(mod).items()):
            if attr.startswith("_") or getattr(obj, "__module__", None) != name:
                continue
            if inspect.isfunction(obj) or inspect.isclass(obj):
                sig = str(inspect.signature(obj)) if inspect.isfunction(obj) else ""
                first = (inspect.getdoc(obj) or "").splitlines()
                out.append(f"- `{attr}{sig}` — {first[0] if first else ''}")
        out.append("")
    with open(os.path.join(root, "docs", "API.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
