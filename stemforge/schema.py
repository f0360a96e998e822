"""Schemas of the library's tables.

A structure is a set of stems; a stem has a left half [lbegin, lend] and a right half [rbegin, rend].  Two stems of a
structure are related by one edge type: s (serial), i (the second lies inside the first), j (its inverse), o
(overlapping, a pseudoknot) or x (mutually exclusive).
"""

from __future__ import annotations

STEMS = "structure_id string, v int, name string, center double, lbegin int, lend int, rbegin int, rend int, lvienna string, rvienna string"
EDGES = "structure_id string, u int, v int, etype string"
CT_BASES = "file string, struct_no int, seq_id string, seq_len int, energy double, pos int, base string, prev int, next int, ppos int"
FINGERPRINTS = "structure_id string, code string, cnt bigint"
FP_INFO = "structure_id string, key string, value string"
MOTIFS = "code string, n_stems int"
MOTIF_PARENTS = "code string, parent string"
DISTANCES = "id1 string, id2 string, jaccard double, bray_curtis double, is_pos boolean"
FASTA = "id string, doc string, sequence string"
STRUCTURE_XML = "_version string, information struct<sequence:struct<id:string,doc:string,unformatted:string>,comment_list:struct<comment:array<string>>>, stem_list string, edge_list string, adjacency string"
#: A labelled graph as a column: edges (v0, v1, e).
GRAPH = "array<struct<v0:int,v1:int,e:string>>"
EDGE_TYPES = "ijosx"
