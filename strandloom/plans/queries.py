"""All registered queries; importing this module fills the registry."""

from strandloom.plans import q_aln, q_cn, q_contig, q_graph, q_io, q_seq, q_sv  # noqa: F401
from strandloom.plans.registry import ORACLES, QUERIES  # noqa: F401
