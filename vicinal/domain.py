"""Domains: what a stored object is, and how objects compare."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .functions.similarity import SIMILARITIES, Similarity

_NUMPY = {"float": ("<f4", 4, T.FloatType()), "uint32": ("<u4", 4, T.LongType()), "int64": ("<i8", 8, T.LongType())}


@dataclass(frozen=True)
class Domain:
    """``kind`` is single (one feature), multi (parts with weight and data) or text (words)."""

    name: str
    kind: str
    dim: int
    element: str
    similarity: str
    matcher: str
    index: str = "kgraph"
    weighted: bool = False
    part_data: tuple[str, ...] = field(default=())

    @property
    def measure(self) -> Similarity:
        return SIMILARITIES[self.similarity]

    @property
    def dtype(self) -> str:
        return _NUMPY[self.element][0]

    @property
    def feature_bytes(self) -> int:
        """Bytes of one stored feature."""
        return self.dim * _NUMPY[self.element][1]

    @property
    def feature_type(self) -> T.DataType:
        return _NUMPY[self.element][2] if self.kind == "text" else T.ArrayType(_NUMPY[self.element][2], False)

    @property
    def schema(self) -> T.StructType:
        """Schema of a stored object."""
        if self.kind == "single":
            return T.StructType([T.StructField("feature", self.feature_type, False)])
        part = [T.StructField("feature", self.feature_type, False)]
        if self.weighted:
            part.insert(0, T.StructField("weight", T.FloatType(), False))
        if self.part_data:
            part.append(T.StructField("data", T.StructType([T.StructField(n, T.FloatType()) for n in self.part_data])))
        return T.StructType([T.StructField("parts", T.ArrayType(T.StructType(part), False), False)])


DOMAINS = {
    d.name: d
    for d in (
        Domain("image", "single", 48, "float", "l2", "trivial"),
        Domain("regions", "multi", 14, "float", "l2", "emd", weighted=True),
        Domain("keypoints", "multi", 4, "uint32", "hamming", "counting", part_data=("x", "y", "r", "t")),
        Domain("text-lsa", "single", 2000, "float", "cosine", "trivial"),
        Domain("text-bits", "single", 32, "uint32", "hamming", "trivial"),
        Domain("text", "text", 1, "int64", "word", "counting", index="inverted"),
    )
}
