"""Numeric archives with shape, type and digest of every array."""

from __future__ import annotations

import hashlib
import io
from pathlib import Path

import numpy as np

from ..operators.constraints import ContractError
from .sinks import publish


def _facts(a: np.ndarray) -> dict:
    return {"shape": list(a.shape), "dtype": a.dtype.str, "sha256": hashlib.sha256(np.ascontiguousarray(a).tobytes()).hexdigest()}


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> dict:
    """Write finite numeric arrays; the manifest returned is needed to read them. The file must not exist."""
    held = {k: np.asarray(v) for k, v in arrays.items()}
    if bad := [k for k, a in held.items() if a.dtype.kind not in "biuf" or not np.isfinite(a).all()]:
        raise ContractError(f"arrays that aren't finite numbers: {bad}")
    out = io.BytesIO()
    np.savez_compressed(out, **held)
    publish(path, out.getvalue())
    return {"sha256": hashlib.sha256(out.getvalue()).hexdigest(), "arrays": {k: _facts(a) for k, a in held.items()}}


def load_arrays(path: str, manifest: dict) -> dict[str, np.ndarray]:
    """The arrays of an archive, or ContractError if the file or any array isn't as the manifest says."""
    content = Path(path).read_bytes()
    if hashlib.sha256(content).hexdigest() != manifest["sha256"]:
        raise ContractError(f"{path} was changed")
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        got = {k: z[k] for k in z.files}
    if {k: _facts(a) for k, a in got.items()} != manifest["arrays"]:
        raise ContractError(f"{path} holds other arrays")
    return got
