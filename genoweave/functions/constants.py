"""Alphabets, genetic code, substitution scores, composition table, cuts and statistics."""

from __future__ import annotations

import numpy as np

AMINO = "ARNDCQEGHILKMFPSTWYV"
RESIDUES = AMINO + "*"

# Standard genetic code, codons in the order A C G T of each position.
CODE = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"

# BLOSUM62 in the order ARNDCQEGHILKMFPSTWYV: the lower triangle, one row a line.
_BLOSUM62 = """
 4
-1  5
-2  0  6
-2 -2  1  6
 0 -3 -3 -3  9
-1  1  0  0 -3  5
-1  0  0  2 -4  2  5
 0 -2  0 -1 -3 -2 -2  6
-2  0  1 -1 -3  0  0 -2  8
-1 -3 -3 -3 -1 -3 -3 -4 -3  4
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""
#: 21 x 21; the row and column of the stop are zero.
BLOSUM62 = np.zeros((21, 21), np.int32)
for _i, _row in enumerate(_BLOSUM62.strip().splitlines()):
    BLOSUM62[_i, : _i + 1] = BLOSUM62[: _i + 1, _i] = np.array(_row.split(), np.int32)

# Expected share of each base (rows A C G T) at the three codon positions.
CODON_SHARE = np.array([(0.274534, 0.314761, 0.207881), (0.219326, 0.240591, 0.282598), (0.331816, 0.171595, 0.257585), (0.174324, 0.273053, 0.251936)])

SNR_WINDOW, SNR_TRAIN, PSI_TRAIN = 1.6, 2.0, 0.015
MAX_RUN, MAX_AA = 4096, 65535
MIN_TRAIN, MIN_BACKGROUND, FULL_BACKGROUND, MIN_REFIT = 10, 100, 1000, 20
SHRINK, OVERLAP = 200, 0.6
START_SCAN, SITE_SCAN, SITE_MIN = 30, 20, 5

# Karlin-Altschul statistics of the gapped scores.
LAMBDA, K, H = 0.267, 0.041, 0.140
GAP_OPEN, GAP_EXTEND, MIN_HSP = 11, 1, 5
E_NONE = 1e30
