"""A small study in the file formats of the readers, and the graph that its manifest makes."""

from pathlib import Path

PATIENTS = "#a\n#b\n#c\n#d\nPATIENT_ID\tOS_STATUS\tOS_MONTHS\tCUSTOM_RISK_GROUP\nTCGA-A1-A0SB\t0:LIVING\t8.5\tlow\nTCGA-A2-A04P\t1:DECEASED\t18\thigh\n"
SAMPLES = "#a\n#b\n#c\n#d\nPATIENT_ID\tSAMPLE_ID\tSAMPLE_TYPE\tCUSTOM_BATCH\nTCGA-A1-A0SB\tTCGA-A1-A0SB-01\tPrimary\tB1\nTCGA-A1-A0SB\tTCGA-A1-A0SB-02\tPrimary\tB2\nTCGA-A2-A04P\tTCGA-A2-A04P-01\tPrimary\tB1\n"
MUTATIONS = (
    "Hugo_Symbol\tChromosome\tStart_Position\tEnd_Position\tReference_Allele\tTumor_Seq_Allele2\tTumor_Sample_Barcode\n"
    "TP53\t17\t7577120\t7577120\tC\tT\tTCGA-A1-A0SB-01\nPIK3CA\t3\t178952085\t178952085\tA\tG\tTCGA-A1-A0SB-02\nTP53\t17\t7578406\t7578406\tC\tA\tTCGA-A2-A04P-01\n"
)
CASES = "stable_id: brca_sequenced\ncase_list_name: Sequenced\ncase_list_ids: TCGA-A1-A0SB-01\t TCGA-A2-A04P-01\t\n"
KINDS = {"patients": "cbio_tsv", "samples": "cbio_tsv", "mutations": "tsv", "cases": "cbio_case_list"}


def write(folder) -> dict[str, str]:
    out = {}
    for name, text in (("patients", PATIENTS), ("samples", SAMPLES), ("mutations", MUTATIONS), ("cases", CASES)):
        out[name] = str(Path(folder, f"{name}.txt"))
        Path(out[name]).write_text(text)
    return out


def registered(engine, folder):
    for name, path in write(folder).items():
        engine.register_source(name, path, KINDS[name])
    return engine
