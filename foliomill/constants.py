"""Fixed values that results depend on.  Kept as plain text, in natural order."""

# Film profiles.
# id, name, kind, manufacturer, note, mask (r, g, b), contrast, gamma
FILM_PROFILES = (
    ("generic_color_negative", "Generic Color Negative", "color_negative", "Generic", "Generic Color Negative color negative profile.", (1.15, 0.62, 0.45), 1.15, 1.0),
    ("kodak_gold_200", "Kodak Gold 200", "color_negative", "Kodak", "Kodak Gold 200 color negative profile.", (1.18, 0.6, 0.42), 1.12, 1.05),
    ("kodak_gold_100", "Kodak Gold 100", "color_negative", "Kodak", "Kodak Gold 100 color negative profile.", (1.16, 0.61, 0.44), 1.1, 1.04),
    ("kodak_gold_400", "Kodak Gold 400", "color_negative", "Kodak", "Kodak Gold 400 color negative profile.", (1.17, 0.59, 0.43), 1.14, 1.05),
    ("kodak_portra_160", "Kodak Portra 160", "color_negative", "Kodak", "Kodak Portra 160 color negative profile.", (1.11, 0.62, 0.47), 1.08, 1.08),
    ("kodak_portra_400", "Kodak Portra 400", "color_negative", "Kodak", "Kodak Portra 400 color negative profile.", (1.12, 0.61, 0.46), 1.1, 1.08),
    ("kodak_portra_800", "Kodak Portra 800", "color_negative", "Kodak", "Kodak Portra 800 color negative profile.", (1.13, 0.6, 0.45), 1.12, 1.06),
    ("kodak_ektar_100", "Kodak Ektar 100", "color_negative", "Kodak", "Kodak Ektar 100 color negative profile.", (1.2, 0.6, 0.4), 1.2, 1.02),
    ("kodak_colorplus_200", "Kodak ColorPlus 200", "color_negative", "Kodak", "Kodak ColorPlus 200 color negative profile.", (1.17, 0.59, 0.44), 1.14, 1.04),
    ("kodak_ultramax_400", "Kodak UltraMax 400", "color_negative", "Kodak", "Kodak UltraMax 400 color negative profile.", (1.16, 0.58, 0.43), 1.13, 1.06),
    ("fuji_superia_100", "Fuji Superia 100", "color_negative", "Fuji", "Fuji Superia 100 color negative profile.", (1.09, 0.64, 0.48), 1.1, 1.05),
    ("fuji_superia_200", "Fuji Superia 200", "color_negative", "Fuji", "Fuji Superia 200 color negative profile.", (1.1, 0.63, 0.47), 1.11, 1.05),
    ("fuji_superia_400", "Fuji Superia 400", "color_negative", "Fuji", "Fuji Superia 400 color negative profile.", (1.1, 0.63, 0.47), 1.12, 1.05),
    ("fuji_pro_400h", "Fuji Pro 400H", "color_negative", "Fuji", "Fuji Pro 400H color negative profile.", (1.08, 0.62, 0.48), 1.08, 1.1),
    ("agfa_vista_200", "Agfa Vista 200", "color_negative", "Agfa", "Agfa Vista 200 color negative profile.", (1.14, 0.61, 0.45), 1.16, 1.03),
    ("cinestill_800t", "CineStill 800T", "color_negative", "CineStill", "CineStill 800T color negative profile.", (1.05, 0.58, 0.7), 1.18, 1.0),
    ("lomography_color_400", "Lomography Color 400", "color_negative", "Lomography", "Lomography Color 400 color negative profile.", (1.17, 0.57, 0.41), 1.2, 1.0),
    ("konica_centuria_200", "Konica Centuria 200", "color_negative", "Konica", "Konica Centuria 200 color negative profile.", (1.14, 0.6, 0.44), 1.13, 1.04),
    ("generic_consumer_cn", "Generic Consumer Color Negative", "color_negative", "Generic", "Generic Consumer Color Negative color negative profile.", (1.16, 0.6, 0.44), 1.14, 1.04),
    ("generic_portrait_cn", "Generic Portrait Color Negative", "color_negative", "Generic", "Generic Portrait Color Negative color negative profile.", (1.11, 0.62, 0.47), 1.09, 1.08),
    ("generic_slide", "Generic Slide", "slide", "Generic", "Generic Slide slide/positive profile.", None, 1.0, 1.0),
    ("fuji_velvia_50", "Fuji Velvia 50", "slide", "Fuji", "Fuji Velvia 50 slide/positive profile.", None, 1.15, 0.95),
    ("fuji_velvia_100", "Fuji Velvia 100", "slide", "Fuji", "Fuji Velvia 100 slide/positive profile.", None, 1.12, 0.97),
    ("fuji_provia_100f", "Fuji Provia 100F", "slide", "Fuji", "Fuji Provia 100F slide/positive profile.", None, 1.0, 1.0),
    ("kodak_ektachrome_e100", "Kodak Ektachrome E100", "slide", "Kodak", "Kodak Ektachrome E100 slide/positive profile.", None, 1.05, 1.05),
    ("kodachrome_64", "Kodachrome 64", "slide", "Kodak", "Kodachrome 64 slide/positive profile.", None, 1.08, 1.0),
    ("agfa_ct_precisa_100", "Agfa CT Precisa 100", "slide", "Agfa", "Agfa CT Precisa 100 slide/positive profile.", None, 1.06, 1.02),
    ("generic_e6_slide", "Generic E-6 Slide", "slide", "Generic", "Generic E-6 Slide slide/positive profile.", None, 1.04, 1.02),
    ("generic_bw_negative", "Generic B&W Negative", "bw_negative", "Generic", "Generic B&W Negative black-and-white negative profile.", None, 1.2, 1.0),
    ("ilford_hp5_plus", "Ilford HP5 Plus", "bw_negative", "Ilford", "Ilford HP5 Plus black-and-white negative profile.", None, 1.25, 1.0),
    ("ilford_fp4_plus", "Ilford FP4 Plus", "bw_negative", "Ilford", "Ilford FP4 Plus black-and-white negative profile.", None, 1.15, 1.05),
    ("ilford_delta_100", "Ilford Delta 100", "bw_negative", "Ilford", "Ilford Delta 100 black-and-white negative profile.", None, 1.28, 0.96),
    ("ilford_delta_400", "Ilford Delta 400", "bw_negative", "Ilford", "Ilford Delta 400 black-and-white negative profile.", None, 1.3, 0.95),
    ("kodak_tri_x_400", "Kodak Tri-X 400", "bw_negative", "Kodak", "Kodak Tri-X 400 black-and-white negative profile.", None, 1.28, 1.0),
    ("kodak_tmax_100", "Kodak T-Max 100", "bw_negative", "Kodak", "Kodak T-Max 100 black-and-white negative profile.", None, 1.3, 0.98),
    ("kodak_tmax_400", "Kodak T-Max 400", "bw_negative", "Kodak", "Kodak T-Max 400 black-and-white negative profile.", None, 1.35, 0.92),
    ("fuji_acros_100", "Fuji Acros 100", "bw_negative", "Fuji", "Fuji Acros 100 black-and-white negative profile.", None, 1.24, 1.0),
    ("fomapan_100", "Fomapan 100", "bw_negative", "Foma", "Fomapan 100 black-and-white negative profile.", None, 1.2, 1.02),
    ("fomapan_400", "Fomapan 400", "bw_negative", "Foma", "Fomapan 400 black-and-white negative profile.", None, 1.24, 1.0),
    ("rolle_rp_x_400", "Rollei RPX 400", "bw_negative", "Rollei", "Rollei RPX 400 black-and-white negative profile.", None, 1.26, 1.0),
    ("kodak_ultramax_800", "Kodak UltraMax 800", "color_negative", "Kodak", "Kodak UltraMax 800 color negative profile.", (1.15, 0.57, 0.42), 1.16, 1.04),
    ("fuji_superia_800", "Fuji Superia 800", "color_negative", "Fuji", "Fuji Superia 800 color negative profile.", (1.11, 0.62, 0.46), 1.14, 1.04),
    ("fuji_c200", "Fuji C200", "color_negative", "Fuji", "Fuji C200 color negative profile.", (1.09, 0.64, 0.48), 1.1, 1.06),
    ("agfa_vista_100", "Agfa Vista 100", "color_negative", "Agfa", "Agfa Vista 100 color negative profile.", (1.14, 0.61, 0.45), 1.14, 1.03),
    ("agfa_vista_400", "Agfa Vista 400", "color_negative", "Agfa", "Agfa Vista 400 color negative profile.", (1.15, 0.6, 0.44), 1.17, 1.02),
    ("cinestill_50d", "CineStill 50D", "color_negative", "CineStill", "CineStill 50D color negative profile.", (1.14, 0.61, 0.44), 1.12, 1.04),
    ("fuji_astia_100f", "Fuji Astia 100F", "slide", "Fuji", "Fuji Astia 100F slide/positive profile.", None, 1.02, 1.02),
    ("kodachrome_25", "Kodachrome 25", "slide", "Kodak", "Kodachrome 25 slide/positive profile.", None, 1.1, 0.98),
    ("ilford_pan_f_plus", "Ilford Pan F Plus", "bw_negative", "Ilford", "Ilford Pan F Plus black-and-white negative profile.", None, 1.22, 1.02),
    ("ilford_xp2_super", "Ilford XP2 Super", "bw_negative", "Ilford", "Ilford XP2 Super black-and-white negative profile.", None, 1.18, 1.04),
    ("fuji_neopan_400", "Fuji Neopan 400", "bw_negative", "Fuji", "Fuji Neopan 400 black-and-white negative profile.", None, 1.22, 1.03),
)

# Scanner makers.
# id, name, USB vendor ids, name tokens, media, ADF, infrared, notes
MANUFACTURERS = (
    ("epson", "Epson", ["04b8"], ["epson", "perfection", "workforce"], ["reflective", "film"], True, True, "Film/transparency + eSCL common."),
    ("canon", "Canon", ["04a9"], ["canon", "canoscan", "pixma"], ["reflective", "film"], True, False, "CanoScan film adapters."),
    ("hp", "HP", ["03f0"], ["hp", "scanjet", "officejet"], ["reflective"], True, False, "ScanJet/OfficeJet."),
    ("brother", "Brother", ["04f9"], ["brother", "ads-", "dcp-"], ["reflective"], True, False, "ADF document scanners."),
    ("fujitsu", "Fujitsu", ["04c5"], ["fujitsu", "fi-", "scansnap"], ["reflective"], True, False, "fi- / ScanSnap document ADF."),
    ("plustek", "Plustek", ["07b3"], ["plustek", "opticfilm"], ["reflective", "film"], False, True, "OpticFilm dedicated film scanners."),
    ("nikon", "Nikon", ["04b0"], ["nikon", "coolscan"], ["film"], False, True, "Coolscan LS film scanners."),
    ("kodak", "Kodak", ["040a"], ["kodak", "alaris"], ["reflective"], True, False, "Document production scanners."),
    ("mustek", "Mustek", ["055f"], ["mustek", "bearpaw"], ["reflective"], False, False, "Consumer flatbeds."),
    ("samsung", "Samsung", ["04e8"], ["samsung", "scx-", "xpress"], ["reflective"], True, False, "MFP scanners."),
)
PREFERRED_BACKENDS = ("wia", "sane", "escl")

# Paper sizes in millimetres, portrait.
PAPER_MM = {
    "auto": None,
    "a4": (210.0, 297.0),
    "a5": (148.0, 210.0),
    "a6": (105.0, 148.0),
    "letter": (215.9, 279.4),
    "legal": (215.9, 355.6),
}

# Phrases that mean the document feeder ran out of paper.
FEEDER_EMPTY_PHRASES = (
    "out of documents",
    "no documents",
    "document feeder empty",
    "paper empty",
    "no paper",
)

# Setting keys that are never stored.
REDACTED_KEYS = (
    "activation",
    "activation_key",
    "license",
    "license_key",
    "serial",
    "serial_number",
    "drm",
    "drm_key",
    "product_key",
)

# Container signatures in hex, in test order; WebP also needs WEBP at byte 8.
WEBP_RIFF_HEX, WEBP_TAG_HEX = "52494646", "57454250"
CONTAINER_PREFIXES = (
    ("0000000C4A584C200D0A870A", "jxl"),
    ("89504E470D0A1A0A", "png"),
    ("FFD8", "jpeg"),
    ("4949", "tiff"),
    ("4D4D", "tiff"),
    ("474946383761", "gif"),
    ("474946383961", "gif"),
    ("424D", "bmp"),
    ("255044462D", "pdf"),
    ("FF0A", "jxl"),
)

# Output formats a page may be saved in.
IMAGE_FORMATS = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp", "gif", "pdf", "jxl")
MULTIPAGE_FORMATS = ("pdf", "tif", "tiff")
OCR_ENGINES = ("offline", "ocrs", "tesseract")

# Text placeholders.
NO_TEXT = "[no text recognized]"

# Glyph templates of 5 x 7 cells, row by row.
GLYPHS = (
    ("0", " ### #   ##   ##   ##   ##   # ### "),
    ("1", "  #   ##    #    #    #    #   ### "),
    ("2", " ### #   #    #   #   #   #   #####"),
    ("3", " ### #   #    # ###     ##   # ### "),
    ("4", "   #   ##  # # #  # #####   #    # "),
    ("5", "######    ####     #    ##   # ### "),
    ("6", " ### #    #### #   ##   ##   # ### "),
    ("7", "#####    #   #   #   #   #   #   # "),
    ("8", " ### #   ##   # ### #   ##   # ### "),
    ("9", " ### #   ##   # ####    ##   # ### "),
    ("A", " ### #   ##   #######   ##   ##   #"),
    ("B", "#### #   ##   ###### #   ##   #### "),
    ("C", " ### #   ##    #    #    #   # ### "),
    ("E", "######    #    #### #    #    #####"),
    ("F", "######    #    #### #    #    #    "),
    ("H", "#   ##   ##   #######   ##   ##   #"),
    ("I", " ###   #    #    #    #    #   ### "),
    ("K", "#   ##  # # #  ##   # #  #  # #   #"),
    ("L", "#    #    #    #    #    #    #####"),
    ("M", "#   ### ### # ## # ##   ##   ##   #"),
    ("N", "#   ###  ## # ##  ###   ##   ##   #"),
    ("O", " ### #   ##   ##   ##   ##   # ### "),
    ("P", "#### #   ##   ###### #    #    #   "),
    ("R", "#### #   ##   ##### # #  #  # #   #"),
    ("S", " ### #   ##     ###     ##   # ### "),
    ("T", "#####  #    #    #    #    #    #  "),
    ("U", "#   ##   ##   ##   ##   ##   # ### "),
    ("V", "#   ##   ##   ##   ##   ## # #  #  "),
    ("W", "#   ##   ##   ## # ## # ### ###   #"),
    ("X", "#   ##   # # #   #   # # #   ##   #"),
    ("Y", "#   ##   # # #   #    #    #    #  "),
    ("Z", "#####    #   #   #   #   #    #####"),
    (".", "                                #  "),
    (",", "                           #   #   "),
    ("-", "               #####               "),
    (":", "            #         #            "),
    (";", "            #         #    #   #   "),
    ("!", "  #    #    #    #    #         #  "),
)

# IT8 chart: six base colours at four scales, then a six-step gray ramp.
IT8_COLUMNS, IT8_ROWS = 6, 5
IT8_BASES = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (0.0, 1.0, 1.0), (1.0, 0.0, 1.0))
IT8_SCALES = (1.0, 0.75, 0.50, 0.30)

# Interface key aliases.
KEY_ALIASES = {
    "button.open": "open",
    "button.save": "output.save",
    "button.save_plus": "save_as",
    "button.save_config": "save_config",
    "button.reprocess": "reprocess",
    "button.preview": "preview",
    "button.scan": "scan",
    "button.cancel": "cancel",
    "button.ocr": "ocr",
    "menu.view": "menu.image",
}
KEY_SYMBOLS = {
    "button.rotate_l": "↶",
    "button.rotate_r": "↷",
    "button.zoom_in": "+",
    "button.zoom_out": "−",
    "button.prev_frame": "‹",
    "button.next_frame": "›",
}
"""Keys shown as a symbol in every language."""

# Languages that have a catalog.
CATALOG_LANGUAGES = (
    "bg", "ca", "cs", "da", "de", "el", "en", "es", "fi", "fr", "hr", "hu", "it", "ja", "ko",
    "nl", "no", "pb", "pl", "pt", "ro", "ru", "sk", "sr", "sv", "tr", "tw", "uk", "zh",
)


def film_profiles() -> list[dict]:
    names = ("film_id", "name", "kind", "manufacturer", "note")
    out = []
    for ordinal, (*texts, mask, contrast, gamma) in enumerate(FILM_PROFILES):
        red, green, blue = mask or (None, None, None)
        out.append(dict(zip(names, texts), ordinal=ordinal, mask_r=red, mask_g=green, mask_b=blue, contrast=contrast, gamma=gamma))
    return out


def manufacturers() -> list[dict]:
    names = ("id", "name", "vids", "tokens", "media", "adf", "ir", "notes")
    return [dict(zip(names, row), ordinal=ordinal) for ordinal, row in enumerate(MANUFACTURERS)]


def glyphs() -> list[tuple[str, str]]:
    """(character, 35 cells)."""
    return list(GLYPHS)


def glyph_bits() -> list[tuple[str, int]]:
    """(character, 35-bit mask); bit i is cell i."""
    return [(ch, sum(1 << i for i, cell in enumerate(cells) if cell == "#")) for ch, cells in glyphs()]
