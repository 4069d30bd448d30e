"""Fixed values of the maintenance domain.

Everything here is data that results depend on: label vocabularies, the rule
table, the manual catalogue, sensor columns, payload defaults and message
texts. Functions take these as parameters, so other vocabularies work too.
"""

# Raw labels that denote an operating state rather than a fault.
OPERATIONAL_STATES = (
    "normal",
    "normal_2",
    "normal_2_pos_2",
    "normal_3",
    "normal_3_pos_2",
    "normal_6",
    "normal_adxl_0",
    "normal_adxl_1",
    "normal_carga",
    "normal_carga_3",
    "normal_carga_3_2",
    "normal_carga_3_3",
    "normal_novo",
    "normal_novo_teste",
    "normal_pos_2",
    "normla_carga_3_3",
    "baseline",
    "new_baseline",
    "teste",
    "new_tes",
    "new_teste",
    "acelerando",
    "motor_desligado",
    "motor_desligado_novo",
    "mortor_desligado_novo",
    "new_normal_0",
    "new_normal_1",
    "new_normal_2",
    "new_normal_3",
    "new_normal_4",
    "new_normal_5",
    "new_normal_6",
)

# Fixed values: (label fragment, category), first match in this order wins.
CATEGORY_RULES = (
    ("normal", "normal"),
    ("baseline", "normal"),
    ("teste", "normal"),
    ("acelerando", "normal"),
    ("motor_desligado", "normal"),
    ("rolamento_outer", "rolamento_pista_externa"),
    ("new_rolamento_outer", "rolamento_pista_externa"),
    ("rolamento_inner", "rolamento_pista_interna"),
    ("new_rolamento_inner", "rolamento_pista_interna"),
    ("rolamento_ball", "rolamento_elementos_rolantes"),
    ("new_rolamento_ball", "rolamento_elementos_rolantes"),
    ("rolamento_combination", "rolamento_combinado"),
    ("rolamento_comb", "rolamento_combinado"),
    ("new_rolamento_comb", "rolamento_combinado"),
    ("desalinhado", "desalinhamento"),
    ("new_desalinhado", "desalinhamento"),
    ("desbalanceado", "desbalanceamento"),
    ("desabalanceado", "desbalanceamento"),
    ("desbanlanceado", "desbalanceamento"),
    ("ddesbalanceado", "desbalanceamento"),
    ("dedesbalanceado", "desbalanceamento"),
    ("new_desbalanceado", "desbalanceamento"),
    ("new_desabanceado", "desbalanceamento"),
    ("correia", "correia"),
    ("polia", "polia"),
    ("cocked_rotor", "cocked_rotor"),
    ("cocked_adxl", "cocked_rotor"),
    ("cockecocked_adxl", "cocked_rotor"),
    ("new_cocked", "cocked_rotor"),
    ("eccentric_rotor", "eccentric_rotor"),
    ("eccentric_adxl", "eccentric_rotor"),
    ("eccentric", "eccentric_rotor"),
    ("new_eccentric", "eccentric_rotor"),
    ("ventoinha", "ventoinha"),
    ("new_falta_fase", "falta_de_fase"),
)

# Category names with a special role.
NORMAL = "normal"
UNKNOWN = "desconhecido"
OTHER_FAULT = "outro_defeito"

# Fixed values: (category, manual, title, has a manual).
DOCUMENT_MAP = (
    ("rolamento_pista_externa", "Doc1.pdf", "Procedimento para Diagnóstico e Correção de Problemas em Rolamentos (Pista Externa)", True),
    ("rolamento_pista_interna", "Doc1.pdf", "Procedimento para Diagnóstico e Correção de Problemas em Rolamentos (Pista Interna)", True),
    ("rolamento_elementos_rolantes", "Doc1.pdf", "Procedimento para Diagnóstico e Correção de Problemas em Rolamentos (Elementos Rolantes)", True),
    ("rolamento_combinado", "Doc1.pdf", "Procedimento para Diagnóstico e Correção de Problemas em Rolamentos (Gaiola / Combinação)", True),
    ("desalinhamento", "Doc2.pdf", "Procedimento para Correção de Desalinhamento em Motor Elétrico", True),
    ("desbalanceamento", "Doc3.pdf", "Procedimento para Correção de Desbalanceamento em Máquinas Rotativas", True),
    ("correia", "Doc4.pdf", "Procedimento para Diagnóstico e Correção de Problemas em Sistemas de Transmissão por Correias", True),
    ("polia", "Doc5.pdf", "Procedimento para Diagnóstico e Correção de Problemas em Polias de Sistemas Rotativos", True),
    ("cocked_rotor", "Doc6.pdf", "Procedimento para Diagnóstico e Correção de Problemas de Rotor Inclinado (Cocked Rotor)", True),
    ("eccentric_rotor", None, "Rotor Excêntrico (Sem Documentação Cadastrada)", False),
    ("ventoinha", None, "Problemas em Ventoinha / Fluxo de Ar (Sem Documentação Cadastrada)", False),
    ("falta_de_fase", None, "Falta de Fase Elétrica (Sem Documentação Cadastrada)", False),
    ("normal", None, "Operação Normal do Equipamento", False),
)
NO_DOCUMENT_TITLE = "Sem Documentação"

# Sensor columns in model order.
SENSORS = (
    "z_rms_velocity_in_s",
    "z_rms_velocity_mm_s",
    "temperature_f",
    "temperature_c",
    "x_rms_velocity_in_s",
    "x_rms_velocity_mm_s",
    "z_peak_acceleration_g",
    "x_peak_acceleration_g",
    "z_peak_vel_comp_freq_hz",
    "x_peak_vel_comp_freq_hz",
    "z_rms_acceleration_g",
    "x_rms_acceleration_g",
    "z_kurtosis",
    "x_kurtosis",
    "z_crest_factor",
    "x_crest_factor",
    "z_peak_velocity_in_s",
    "z_peak_velocity_mm_s",
    "x_peak_velocity_in_s",
    "x_peak_velocity_mm_s",
    "z_high_freq_rms_accel_g",
    "x_high_freq_rms_accel_g",
    "rpm",
)

# Engineered ratio name -> (numerator, denominator).
AXIS_RATIOS = {
    "vel_ratio_zx": ("z_rms_velocity_mm_s", "x_rms_velocity_mm_s"),
    "acc_ratio_zx": ("z_peak_acceleration_g", "x_peak_acceleration_g"),
    "rms_acc_ratio_zx": ("z_rms_acceleration_g", "x_rms_acceleration_g"),
    "kurtosis_ratio_zx": ("z_kurtosis", "x_kurtosis"),
    "crest_ratio_zx": ("z_crest_factor", "x_crest_factor"),
    "high_freq_ratio_zx": ("z_high_freq_rms_accel_g", "x_high_freq_rms_accel_g"),
}
RATIO_EPSILON = 1e-6
ENERGIES = ("vibration_energy_z", "vibration_energy_x", "total_vibration_energy")
ENGINEERED = tuple(AXIS_RATIOS) + ENERGIES
FEATURES = SENSORS + ENGINEERED

# Columns of the stored readings table, in order.
STORED_COLUMNS = (
    "id", "created_at", "fault", "fault_category", "is_problem",
    "rpm", "temperature_c", "temperature_f", "z_rms_velocity_mm_s",
    "x_rms_velocity_mm_s", "z_peak_acceleration_g", "x_peak_acceleration_g",
    "z_peak_vel_comp_freq_hz", "x_peak_vel_comp_freq_hz",
    "z_rms_acceleration_g", "x_rms_acceleration_g", "z_kurtosis",
    "x_kurtosis", "z_crest_factor", "x_crest_factor",
    "z_peak_velocity_mm_s", "x_peak_velocity_mm_s",
    "z_high_freq_rms_accel_g", "x_high_freq_rms_accel_g",
    "total_vibration_energy",
)

# Numeric payload fields that must be present.
REQUIRED_FIELDS = (
    "rpm",
    "temperature_c",
    "z_rms_velocity_mm_s",
    "x_rms_velocity_mm_s",
    "z_peak_acceleration_g",
    "x_peak_acceleration_g",
    "z_rms_acceleration_g",
    "x_rms_acceleration_g",
    "z_kurtosis",
    "x_kurtosis",
    "z_crest_factor",
    "x_crest_factor",
    "z_high_freq_rms_accel_g",
    "x_high_freq_rms_accel_g",
)

# What an absent optional payload field stands for.
PAYLOAD_DEFAULTS = {
    "temperature_f": 76.44,
    "z_rms_velocity_in_s": 0.0597,
    "x_rms_velocity_in_s": 0.0787,
    "z_peak_vel_comp_freq_hz": 61.0,
    "x_peak_vel_comp_freq_hz": 61.0,
    "z_peak_velocity_mm_s": 2.146,
    "x_peak_velocity_mm_s": 2.829,
    "z_peak_velocity_in_s": 0.0844,
    "x_peak_velocity_in_s": 0.1113,
}

# Tokens a CSV reader treats as a missing text.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Sizes and limits.
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
MIN_DIGITAL_CHARS = 30
SIMILAR_TOP_K = 10
SHOWN_MATCHES = 5
SHOWN_PROBABILITIES = 6
CONTEXT_CHUNKS = 4
CHAT_WINDOW = 6
TEST_FRACTION = 0.2
SPLIT_SEED = 42

# Message texts. Braces mark the places that are filled in.
NORMAL_TEXT = (
    "### ✅ Estado Operacional: Normal\n\n"
    "Os parâmetros estatísticos e de vibração indicam que o equipamento está operando dentro das faixas nominais seguras.\n"
    "- **Recomendação**: Manter o plano de monitoramento preditivo de rotina.\n"
    "- **Ação**: Nenhuma intervenção corretiva necessária no momento."
)
MISSING_TEXT = (
    "### ⚠️ Defeito Identificado: {category_title} (Sem Procedimento Cadastrado)\n\n"
    "O sistema de Inteligência Artificial diagnosticou o padrão vibracional como **{category}** "
    "com **{confidence}%** de confiança e localizou **{occurrences}** ocorrências históricas semelhantes.\n\n"
    "> **Atenção:** Ainda **não existe documentação técnica ou manual cadastrado** para esta categoria de falha na base corporativa.\n\n"
    "#### 📋 Ação Recomendada:\n"
    "1. A equipe técnica/especialista deve registrar e anexar um novo documento orientativo (PDF) na aba de **Documentos**.\n"
    "2. Realizar inspeção preventiva manual no maquinário para avaliar o componente.\n"
    "3. Após o upload do procedimento, o modelo passará a prescrever a correção automaticamente."
)
RETRIEVAL_TEXT = (
    "Procedimento de correção e diagnóstico para defeito de {category} vibração temperatura rotação"
)
SENSOR_SUMMARY = (
    "- ID do Evento: {id}\n"
    "- Rotação: {rpm} RPM\n"
    "- Temperatura: {temperature_c} °C ({temperature_f} °F)\n"
    "- Vibração RMS Z: {z_rms_velocity_mm_s} mm/s | X: {x_rms_velocity_mm_s} mm/s\n"
    "- Aceleração Pico Z: {z_peak_acceleration_g} g | X: {x_peak_acceleration_g} g\n"
    "- Kurtosis Z: {z_kurtosis} | X: {x_kurtosis}\n"
    "- Crest Factor Z: {z_crest_factor} | X: {x_crest_factor}"
)
HISTORY_SUMMARY = (
    "- Eventos similares no histórico: {similar_count}\n"
    "- Total histórico nesta categoria: {occurrences}\n"
    "- RPM médio histórico: {avg_rpm} RPM\n"
    "- Temperatura média histórica: {avg_temp_c} °C"
)
SYNTHESIS_HEAD = (
    "### 🛠️ Prescrição Técnica: {category_title}",
    "**Diagnóstico de IA:** {category} (Confiança: **{confidence}%**)\n",
    "**Manual de Referência:** *{title}*\n",
    "#### 📊 Contexto do Evento e Histórico:",
    "```\n{sensor_summary}\n\n{history_summary}\n```\n",
    "#### 📖 Procedimentos e Ações Extraídas dos Manuais Técnicos:",
)
SYNTHESIS_EXCERPT = "> **Trecho Técnico {number}:**\n{text}\n"
SYNTHESIS_TAIL = (
    "#### 🛡️ Medidas de Segurança Obrigatórias:",
    "1. Desligar e desenergizar o motor/equipamento antes de qualquer intervenção.",
    "2. Aplicar procedimento padrão de Bloqueio e Etiquetagem (LOTO).",
    "3. Utilizar EPIs adequados (óculos, luvas, calçado de segurança, protetor auricular).",
    "4. Confirmar parada total das partes girantes antes da inspeção mecânica.",
)
CONTEXT_EXCERPT = "[Trecho {number}]: {text}"
PROMPT_TEXT = (
    "\n## Evento Monitorado\n"
    "- Diagnóstico IA: **{category_upper}** (Confiança: {confidence}%)\n"
    "- Documento Referência: {title}\n\n"
    "### Dados do Sensor em Tempo Real:\n{sensor_summary}\n\n"
    "### Padrão Histórico e Contexto Operacional:\n{history_summary}\n\n"
    "### Procedimento Técnico Extraído da Documentação Oficial:\n{context}\n\n"
    "Gere a prescrição técnica detalhada e objetiva para a equipe de manutenção de chão de fábrica.\n"
)
CHAT_CONTEXT = "[Contexto do Evento Atual: Defeito={fault_category}, Confiança={confidence}%]\n"
PAGE_HEADER = "\n--- Página {number} ---\n"
PAGE_HEADER_OCR = "\n--- Página {number} (OCR) ---\n"
PAGE_MARK = "--- Página"
PAGE_MARK_SHOWN = "\n*Página"
