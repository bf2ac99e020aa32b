"""A writer of small ONNX models, and their sessions: networks trained here run in onnxruntime inside tasks.

Only the messages that such a model needs: nodes with integer attributes, constants, inputs and outputs of two
dimensions of any size, all of 32-bit floats but for index constants.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

OPSET, FORMAT = 17, 8
_FLOAT, _LONG = 1, 7


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data


class Graph:
    """Nodes in the order of their calls; every call names its output."""

    def __init__(self) -> None:
        self._nodes: list[bytes] = []
        self._constants: list[bytes] = []

    def constant(self, name: str, value: np.ndarray) -> str:
        kind = _LONG if value.dtype == np.int64 else _FLOAT
        data = np.ascontiguousarray(value, np.int64 if kind == _LONG else np.float32)
        self._constants.append(_field(5, b"".join(_field(1, n) for n in data.shape) + _field(2, kind) + _field(8, name) + _field(9, data.tobytes())))
        return name

    def node(self, op: str, inputs: Sequence[str], *outputs: str, **attributes: int) -> str:
        named = b"".join(_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in attributes.items())
        self._nodes.append(_field(1, b"".join(_field(1, x) for x in inputs) + b"".join(_field(2, x) for x in outputs) + _field(4, op) + named))
        return outputs[0]

    def model(self, inputs: Sequence[str], outputs: Sequence[str]) -> bytes:
        def matrix(name: str) -> bytes:
            sizes = b"".join(_field(1, _field(2, f"{name}_{k}")) for k in range(2))
            return _field(1, name) + _field(2, _field(1, _field(1, _FLOAT) + _field(2, sizes)))

        parts = [*self._nodes, _field(2, "graph"), *self._constants, *(_field(11, matrix(x)) for x in inputs), *(_field(12, matrix(x)) for x in outputs)]
        return _field(1, FORMAT) + _field(7, b"".join(parts)) + _field(8, _field(2, OPSET))


@lru_cache(maxsize=1)
def session(model: bytes):
    """A model ready to run in one thread, kept for the later tasks of a worker; None where onnxruntime is not there."""
    try:
        import onnxruntime
    except ModuleNotFoundError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    options.log_severity_level = 3
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
