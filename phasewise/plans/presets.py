"""Study presets: rule texts and bands that results depend on."""

from phasewise.operators.columns import TextRule as R

# Phrases of recorded history, neutralised before classes are looked for.
HISTORY_PHRASES = [
    (r"H/O TUBERCULOSIS|HX OF TUBERCULOSIS", "HX_TB_RECORDED"),
    (r"H/O PCP|HX OF PCP", "HX_PCP_RECORDED"),
]

# Diagnosis classes, severe ones first; the first rule that applies decides.
DIAGNOSIS_RULES = [
    R("PCP", (r"PNEUMOCYST|PNEUMOCYT|\bPCP\b|JIROVECI",)),
    R("Active Tuberculosis (ADE)", (r"\bTUBERCULOSIS\b|\bPOTT\b|\bTUBERCLE\b|\bTUBERCULOUS",)),
    R("MAC/Atypical Mycobacteria", (r"\bMAC\b|MYCOBACTERIUM AVIUM|\bKANSASII\b|\bMYCOBACTERI|D/T MYCOBACTERIA",)),
    R("Toxoplasmosis", (r"\bTOXO",)),
    R("Cryptococcosis", (r"\bCRYPTOCOCC",)),
    R("Histoplasmosis", (r"\bHISTOPLASM",)),
    R("Coccidioidomycosis", (r"\bCOCCIDIOID",)),
    R("Cryptosporidiosis", (r"\bCRYPTOSPORIDI",)),
    R("CMV End-Organ Disease (ADE)", (r"\bCMV\b|CYTOMEGALO",
                                      r"RETINITIS|RETINA|COLITIS|ESOPHAGITIS|ENCEPHALITIS|PNEUMONIA|ENTERITIS|DISEASE")),
    R("Herpes Simplex (Severe/ADE)", (r"HERPES SIMPLEX",)),
    R("Kaposi Sarcoma", (r"\bKAPOSI",)),
    R("Lymphoma (AIDS-Defining)", (r"LYMPHOMA", r"NON[- ]?HODGKIN")),
    R("Lymphoma (AIDS-Defining)", (r"LYMPHOMA",), (r"\bHODGKIN",)),
    R("Candidiasis (ADE: Esophageal/Pulmonary)",
      (r"CANDID.*(ESOPHAG|LUNG|TRACHEA|BRONCH)|(ESOPHAG|LUNG|TRACHEA|BRONCH).*CANDID|CANDIDIASIS OF THE ESOPHAGUS",)),
    R("HIV Wasting Syndrome (ADE)", (r"WASTING|CACHEXIA",)),
    R("Neuro/PML/Dementia (ADE)", (r"DEMENTIA|ENCEPHALOPATHY|\bPML\b|MULTIFOCAL|LEUKOENCEPHALOPATHY",)),
    R("Recurrent Bacterial Pneumonia (ADE)", (r"RECURR.*PNEUMONIA",)),
    R("Salmonella Septicemia (ADE)", (r"SALMONELLA.*(SEPTICEMIA|BACTEREMIA)",)),
    R("Latent TB / History (Non-ADE)", (r"\bLTBI\b|\bPPD\b|HX_TB_RECORDED",)),
    R("CMV Viremia/NOS (Non-ADE)", (r"CYTOMEGALOVIRUS INFECTION|CYTOMEGALOVIRUS VIREMIA|\bCMV\b|CYTOMEGALO",)),
    R("Oral Candidiasis (Non-ADE)", (r"CANDIDIASIS OF MOUTH|ORAL CANDID",)),
    R("Generic Weight Loss (Non-Specific)", (r"WEIGHT LOSS|LOSS OF WEIGHT",)),
    R("Altered Mental Status (Non-Specific)", (r"ALTERED MENTAL STATUS",)),
    R("Bacterial Pneumonia (Single/Unspecified)",
      (r"(BACTERIAL|LOBAR|PNEUMOCOCCAL|STAPHYLOCOCCUS).*PNEUMONIA|PNEUMONIA.*(BACTERIAL|LOBAR|PNEUMOCOCCAL|STAPHYLOCOCCUS)",)),
    R("Pneumonia (Other/NOS)", (r"PNEUMONIA|PNEUMONITIS",)),
    R("Meningitis (Other/NOS)", (r"MENINGITIS",)),
    R("Esophagitis (Other/NOS)", (r"ESOPHAGITIS",)),
    R("Enteric/Gastrointestinal", (r"COLITIS|GASTRITIS|SALMONELLA|ENTERITIS",)),
    R("Retinitis (NOS)", (r"RETINITIS",)),
]

# The result window around the target date, in days.
RESULT_WINDOW_DAYS = (-180, 30)
