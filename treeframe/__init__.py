"""treeframe: XML documents as typed Spark DataFrames."""

from .operators.extract import extract
from .operators.nodes import find, nodes
from .operators.udtf import register
from .plans.paths import PathError
from .plans.spec import Attr, Child, MapOf, Part, Poly, Record, Self, Text, record
from .plans.validate import SpecError
from .sources.files import read_files, read_large
from .streaming.files import stream_files

__all__ = ["Attr", "Child", "MapOf", "Part", "PathError", "Poly", "Record", "Self", "SpecError", "Text", "extract", "find", "nodes", "read_files", "read_large", "record", "register", "stream_files"]
