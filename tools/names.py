"""Print the query names registered in the given workload modules."""

import importlib
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sentivane.workload.registry import QUERIES  # noqa: E402

wanted = {f"sentivane.workload.{m}" for m in sys.argv[1:]}
for m in wanted:
    importlib.import_module(m)
print(*[k for k, f in QUERIES.items() if f.__module__ in wanted])
