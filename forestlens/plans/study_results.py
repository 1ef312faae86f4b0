"""The study's published results: confusion matrices of its four runs as ``actual,predicted,count`` lines (every other
cell is 0), their metrics and its class counts. Fixed values, checked by the tests and recomputed by the bench."""

from __future__ import annotations

import csv
import io

# --- fixed values: saved results of the four study runs ---------------------
RF_BASE = """\
actual,predicted,count
back,back,204
back,normal,1
buffer_overflow,buffer_overflow,3
buffer_overflow,normal,4
ftp_write,normal,1
guess_passwd,guess_passwd,14
guess_passwd,normal,1
imap,imap,2
imap,neptune,1
imap,normal,1
ipsweep,ipsweep,723
ipsweep,normal,7
land,land,2
land,portsweep,1
loadmodule,normal,4
multihop,buffer_overflow,2
neptune,neptune,47768
nmap,ipsweep,6
nmap,nmap,287
nmap,normal,14
perl,normal,1
pod,pod,37
pod,normal,1
portsweep,portsweep,695
portsweep,normal,3
rootkit,normal,5
satan,satan,943
satan,normal,10
smurf,smurf,597
smurf,normal,3
teardrop,teardrop,189
warezclient,warezclient,184
warezclient,normal,16
warezmaster,warezmaster,3
warezmaster,normal,2
normal,land,3
normal,satan,1
normal,warezclient,4
normal,normal,162334
"""
RF_BASE_METRICS = (0.9995102422786248, 0.9995702480883046, 0.9995402442828764)

RF_BASE_TEST = """\
actual,predicted,count
back,back,1091
back,normal,7
buffer_overflow,normal,22
ftp_write,normal,3
guess_passwd,normal,4367
imap,normal,1
ipsweep,ipsweep,298
ipsweep,smurf,3
ipsweep,normal,5
land,land,5
land,neptune,1
land,normal,3
loadmodule,normal,2
multihop,normal,18
neptune,neptune,57984
neptune,portsweep,10
neptune,satan,1
neptune,normal,6
nmap,nmap,84
perl,normal,2
phf,normal,2
pod,pod,81
pod,normal,6
portsweep,portsweep,354
rootkit,normal,13
satan,portsweep,1
satan,satan,1629
satan,normal,3
smurf,smurf,164091
teardrop,teardrop,12
warezmaster,warezclient,182
warezmaster,warezmaster,1
warezmaster,normal,1419
normal,neptune,1
normal,pod,15
normal,portsweep,64
normal,satan,144
normal,smurf,3
normal,teardrop,37
normal,normal,60327
apache2,neptune,17
apache2,normal,777
httptunnel,satan,1
httptunnel,normal,157
mailbomb,normal,5000
mscan,ipsweep,1
mscan,neptune,195
mscan,satan,4
mscan,normal,853
named,ipsweep,1
named,normal,16
processtable,normal,759
ps,warezmaster,1
ps,normal,15
saint,ipsweep,101
saint,portsweep,1
saint,satan,624
saint,normal,10
sendmail,normal,17
snmpgetattack,normal,7741
snmpguess,normal,2406
sqlattack,normal,2
udpstorm,satan,2
worm,normal,2
xlock,normal,9
xsnoop,normal,4
xterm,normal,13
"""
RF_BASE_TEST_METRICS = (0.8651592672908874, 0.9193960652933668, 0.8914534749084669)

RF_BIN_TEST = """\
actual,predicted,count
anomaly,anomaly,227474
anomaly,normal,22962
normal,anomaly,281
normal,normal,60310
"""
RF_BIN_TEST_METRICS = (0.9452884577859303, 0.9252701533950429, 0.9351721898582419)

RF_BIN200_TEST = """\
actual,predicted,count
anomaly,anomaly,227275
anomaly,normal,23161
normal,anomaly,284
normal,normal,60307
"""
RF_BIN200_TEST_METRICS = (0.9449386737251902, 0.9246206920942556, 0.9346692771143514)

# class, count, de-duplicated count (training set)
CLASS_COUNTS = [
    ("smurf", 2807886, 3007), ("neptune", 1072017, 242149), ("normal", 972781, 812814), ("satan", 15892, 5019),
    ("ipsweep", 12481, 3723), ("portsweep", 10413, 3564), ("nmap", 2316, 1554), ("back", 2203, 968),
    ("warezclient", 1020, 893), ("teardrop", 979, 918), ("pod", 264, 206), ("guess_passwd", 53, 53),
    ("buffer_overflow", 30, 30), ("land", 21, 19), ("warezmaster", 20, 20), ("imap", 12, 12), ("rootkit", 10, 10),
    ("loadmodule", 9, 9), ("ftp_write", 8, 8), ("multihop", 7, 7), ("phf", 4, 4), ("perl", 3, 3), ("spy", 2, 2),
]
CATEGORY_COUNTS = {
    "dos": (3883370, 247267), "normal": (972781, 812814), "probe": (41102, 13860), "r2l": (1126, 999),
    "u2r": (52, 52), "TOTAL": (4898431, 1074992),
}
UNSEEN_TEST_ROWS, TEST_ROWS = 18729, 311027
# --- end of fixed values ----------------------------------------------------


def cells(text: str) -> list[tuple[str, str, int]]:
    """``(actual, predicted, count)`` of a matrix above."""
    return [(r["actual"], r["predicted"], int(r["count"])) for r in csv.DictReader(io.StringIO(text))]


def saved_layout(text: str, classes: list[str], numbered: bool = False) -> str:
    """A matrix as its saved file has it: ``A\\P`` and class names, or (``numbered``) a blank corner and row numbers."""
    n = {(a, p): c for a, p, c in cells(text)}
    lines = [",".join(["" if numbered else "A\\P", *classes])]
    for i, a in enumerate(classes):
        lines.append(",".join([str(i) if numbered else a, *[f"{n.get((a, p), 0)}.0" for p in classes]]))
    return "\n".join(lines) + "\n"
