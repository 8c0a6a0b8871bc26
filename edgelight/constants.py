"""Fixed values that results depend on."""

import math

#: E = KTOE k^2 (eV, 1/Angstrom) of the fitting side and of the reduction side; they differ and are kept apart
KTOE_FIT = 3.8099819442818976
KTOE = 3.8099821161548597
ETOK = 1.0 / KTOE
#: Duplicate-energy nudge, eV
TINY_ENERGY = 0.0005
#: Einstein sigma^2 factor
EINS_FACTOR = 24.254367090467216
MAX_NNORM = 5
FT_NFFT, FT_KSTEP = 2048, 0.05
PI = math.pi
