"""Names of output files, from those of inputs."""

from __future__ import annotations

import os

MODES = {1: "rules", 2: "neural", 3: "neural+lm", 4: "neural+lm+rules", 5: "rules+neural+lm", 6: "rules+neural"}
#: What each step adds before the extension.
SUFFIXES = {"noise": "_noiseout", "swap": "_augmented", "rules": "_ruleout", "abbreviations": "_abbrev", "expansions": "_dictaug", "tokens": "-tok"}


def for_step(path: str, step: str) -> str:
    base, ext = os.path.splitext(path)
    return f"{base}{SUFFIXES[step]}{ext}"


def for_predictions(path: str, mode: int) -> str:
    """`source` in a file's name becomes predictions-<n>-<mode>; a name without it gets that at its end."""
    if mode not in MODES:
        raise ValueError(f"modes are 1 to {len(MODES)}")
    folder, name = os.path.split(path)
    base, ext = os.path.splitext(name)
    tag = f"predictions-{mode}-{MODES[mode]}"
    new = base.replace("source", tag) if "source" in base else f"{base}_{tag}"
    return os.path.join(folder, new + ext)


def for_report(path: str, kind: str, intervals: bool = False) -> str:
    """kind: "report" (text) or "eval" (JSON)."""
    base = os.path.splitext(path)[0]
    return f"{base}_eval.json" if kind == "eval" else f"{base}_eval_{'CI' if intervals else ''}report.txt"


def readable_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} TB"
