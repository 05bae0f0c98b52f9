"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

# Stop words of the tokenizer.
STOP_WORDS = (
    "dan atau yang di ke dari ini itu dengan untuk pada adalah sebagai dalam tidak akan dapat telah oleh juga sudah saat setelah bisa ada mereka "
    "kami kita saya anda ia dia kamu beliau tersebut hal antara lain seperti serta bahwa karena secara namun tetapi hanya jika maka agar ketika "
    "hingga sampai masih pun lagi sangat lebih kurang hampir selalu sering kadang jarang begitu demikian yakni yaitu penelitian berdasarkan "
    "menurut menunjukkan menggunakan terhadap melalui terdapat merupakan dilakukan diperoleh apa siapa dimana kapan mengapa bagaimana berapa"
).split()

# Affixes of the stemmer, in the order in which they are tried.
SUFFIXES = ("kan", "an", "i", "lah", "kah", "nya")
PREFIXES = ("meng", "mem", "men", "me", "peng", "pem", "pen", "pe", "di", "ter", "ber", "ke", "se")

# Constants of BM25, rank fusion and retrieval.
K1, B, K3, DELTA = 1.2, 0.75, 8, 1.0
RRF_K = 60
TOP_K, MIN_SCORE, VECTOR_POOL, KEYWORD_POOL = 10, 0.01, 3, 10
RERANK_TOP_K, RERANK_MIN_SCORE = 5, 0.3
CONTEXT_TOP_K, CONTEXT_TOKENS = 5, 4000

# Patterns of personal data, in the order of redaction. A leading (?i) marks case-insensitive ones.
PII = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b(\+?62|0)[\s-]?\d{2,4}[\s-]?\d{3,4}[\s-]?\d{3,4}\b"),
    ("phone_us", r"\b(\+?1?[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"),
    ("nik", r"\b\d{16}\b"),
    ("ssn", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"),
    ("creditCard", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"),
    ("studentId", r"(?i)\b[A-Z]{0,3}\d{6,10}\b"),
    ("nim", r"(?i)\b(NIM|NPM)[\s:.-]?\d{8,15}\b"),
    ("ipAddress", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
)
CRITICAL_PII = ("nik", "ssn", "creditCard")

# Patterns of prompt injection.
INJECTION = (
    r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"disregard\s+(all\s+)?(previous|prior|above)",
    r"forget\s+(everything|all|your)\s+(you|instructions?|rules?)",
    r"you\s+are\s+now\s+(a|an|in)\s+(new|different|jailbreak)",
    r"pretend\s+(you\s+are|to\s+be)\s+(a|an)",
    r"act\s+as\s+(if|though)\s+you",
    r"override\s+(your|all|the)\s+(instructions?|rules?|guidelines?)",
    r"bypass\s+(your|all|the)\s+(restrictions?|limitations?|filters?)",
    r"system\s*:\s*",
    r"\[INST\]",
    r"<<SYS>>",
    r"\{\{.*system.*\}\}",
    r"abaikan\s+(semua\s+)?(instruksi|perintah|aturan)\s+(sebelumnya|di\s+atas)",
    r"lupakan\s+(semua|seluruh)\s+(instruksi|perintah|aturan)",
    r"pura-pura\s+(menjadi|jadi)\s+",
    r"anggap\s+(dirimu|kamu)\s+sebagai",
    r"ganti\s+(peran|fungsi|tugas)mu\s+menjadi",
)

# Patterns of toxicity.
TOXICITY = (
    r"\b(hate|kill|murder|attack|destroy|harm)\s+(the|all|every)\b",
    r"\b(racist|sexist|homophobic|transphobic)\b",
    r"\bcheating\s+(on|in)\s+(exam|test|assignment)",
    r"\bplagiarize?\b",
    r"\bbuy\s+(essay|paper|assignment|homework)",
    r"\b(bunuh|serang|hancurkan|musnahkan)\s+(semua|seluruh)\b",
    r"\b(rasis|seksis)\b",
    r"\bcontek(an)?\s+(ujian|tugas|uas|uts)",
    r"\bplagiasi\b",
    r"\bjual\s+(skripsi|tugas|makalah)\b",
    r"\bjoki\s+(skripsi|tugas|ujian)\b",
    r"\bbeli\s+(skripsi|tugas|makalah)\b",
)

# Patterns against academic integrity.
INTEGRITY = (
    r"write\s+(my|the|an?)\s+(essay|paper|assignment|homework)\s+for\s+me",
    r"do\s+(my|the)\s+(homework|assignment|thesis)\s+for\s+me",
    r"complete\s+(my|the)\s+(exam|test|quiz)\s+for\s+me",
    r"buatkan\s+(saya\s+)?(skripsi|tugas|makalah|esai)",
    r"kerjakan\s+(tugas|pr|ujian|skripsi)\s+(saya|ku)",
    r"bantu\s+contek",
    r"tolong\s+(buatkan|kerjakan)\s+(skripsi|tesis|tugas)",
    r"carikan\s+jawaban\s+(ujian|uts|uas)",
)

# Reactions, their severities, and their patterns; Indonesian ones are tried first, then English ones.
REACTION_SEVERITY = {"frustration": "high", "disappointment": "medium", "confusion": "low", "helpRequest": "low"}
REACTIONS_ID = (
    ("frustration", r"ini\s+(tidak\s+)?(berguna|guna|membantu)"),
    ("frustration", r"kamu\s+(bodoh|tolol|goblok|tidak\s+berguna)"),
    ("frustration", r"buang(-buang)?\s+(waktu|tenaga)"),
    ("frustration", r"tidak\s+(masuk\s+akal|membantu|benar)"),
    ("frustration", r"saya\s+(frustrasi|kesal|marah|jengkel)"),
    ("frustration", r"berhenti\s+(memberi|kasih)\s+jawaban\s+(salah|tidak\s+berguna)"),
    ("frustration", r"apa\s+sih\s+ini"),
    ("frustration", r"masa\s+(begini|gitu)\s+aja\s+(tidak|nggak)\s+bisa"),
    ("disappointment", r"saya\s+(kecewa|harap\s+lebih\s+baik)"),
    ("disappointment", r"(bukan|tidak)\s+(itu|ini)\s+yang\s+(saya\s+)?(mau|tanya|maksud)"),
    ("disappointment", r"kamu\s+(salah|tidak)\s+paham"),
    ("disappointment", r"(jawaban|ini)\s+salah(\s+lagi)?"),
    ("disappointment", r"mengecewakan"),
    ("confusion", r"saya\s+(tidak|nggak)\s+(paham|mengerti|ngerti)"),
    ("confusion", r"(ini\s+)?membingungkan"),
    ("confusion", r"apa\s+(maksud|artinya)(mu|nya)?"),
    ("confusion", r"(tidak|nggak)\s+masuk\s+akal"),
    ("confusion", r"hah\??"),
    ("confusion", r"jelaskan\s+(lagi|lebih\s+jelas)"),
    ("confusion", r"bingung"),
    ("helpRequest", r"tolong\s+(bantu|bantuin)"),
    ("helpRequest", r"saya\s+(butuh|perlu)\s+bantuan"),
    ("helpRequest", r"bisa\s+(tolong\s+)?bantu"),
    ("helpRequest", r"saya\s+(buntu|stuck|mentok)"),
    ("helpRequest", r"saya\s+(tidak|nggak)\s+tahu\s+(harus|mau)\s+(apa|bagaimana|gimana)"),
)
REACTIONS_EN = (
    ("frustration", r"this\s+(is\s+)?(useless|worthless|garbage|trash|terrible|awful|horrible)"),
    ("frustration", r"you('re|\s+are)\s+(useless|stupid|dumb|terrible|the\s+worst)"),
    ("frustration", r"what\s+a\s+(waste|joke)"),
    ("frustration", r"this\s+doesn'?t\s+(work|help|make\s+sense)"),
    ("frustration", r"i('m|\s+am)\s+(frustrated|annoyed|angry|upset)"),
    ("frustration", r"stop\s+(wasting|giving)\s+(my\s+time|wrong\s+answers)"),
    ("frustration", r"can'?t\s+you\s+(understand|do\s+anything\s+right)"),
    ("disappointment", r"i\s+expected\s+(better|more)"),
    ("disappointment", r"this\s+is\s+(disappointing|not\s+what\s+i\s+(asked|wanted|needed))"),
    ("disappointment", r"you\s+(missed|didn'?t\s+understand)\s+(the\s+point|my\s+question)"),
    ("disappointment", r"that'?s\s+not\s+(right|correct|what\s+i\s+meant)"),
    ("disappointment", r"wrong\s+(again|answer)"),
    ("confusion", r"i\s+don'?t\s+understand"),
    ("confusion", r"this\s+(is\s+)?confusing"),
    ("confusion", r"what\s+(do\s+you\s+mean|are\s+you\s+(saying|talking\s+about))"),
    ("confusion", r"makes?\s+no\s+sense"),
    ("confusion", r"huh\??"),
    ("confusion", r"explain\s+(better|more\s+clearly|again)"),
    ("helpRequest", r"please\s+help"),
    ("helpRequest", r"i\s+(really\s+)?need\s+help"),
    ("helpRequest", r"can\s+you\s+(please\s+)?help"),
    ("helpRequest", r"i('m|\s+am)\s+stuck"),
    ("helpRequest", r"i\s+don'?t\s+know\s+(what\s+to\s+do|how)"),
)

# Topic words, command verbs and question cues of the relevance check.
TOPICS = (
    "research|study|paper|thesis|dissertation|lecture|course|assignment|exam|grade|professor|student|university|college|curriculum|syllabus|citation|"
    "bibliography|methodology|hypothesis|experiment|data|analysis|conclusion|abstract|literature|review|theory|concept|framework|model|algorithm|"
    "equation|formula|proof|theorem|definition|example|exercise|chapter|section|penelitian|studi|makalah|skripsi|tesis|disertasi|kuliah|tugas|ujian|"
    "nilai|dosen|mahasiswa|universitas|perguruan tinggi|kurikulum|silabus|sitasi|daftar pustaka|metodologi|hipotesis|eksperimen|analisis|kesimpulan|"
    "abstrak|tinjauan pustaka|teori|konsep|kerangka|algoritma|persamaan|rumus|bukti|teorema|definisi|contoh|latihan|bab|bagian|mata kuliah|semester|"
    "sks|kampus|fakultas|jurusan|prodi"
).split("|")
COMMANDS = (
    "summarize summarise analyze analyse explain describe define check review evaluate critique compare contrast discuss interpret translate correct "
    "improve help find identify extract highlight ringkas analisis jelaskan deskripsikan definisikan periksa tinjau evaluasi bandingkan kontraskan "
    "diskusikan interpretasikan terjemahkan koreksi tingkatkan bantu cari identifikasi ekstrak sorot"
).split()
QUESTION = r"\?|what|how|why|when|where|who|explain|describe|define|apa|bagaimana|mengapa|kapan|dimana|siapa|jelaskan|definisikan"

# Citations in answers, and claims that call for a check.
CITATION = r"\[(\d+)\]|\(([A-Za-z\s]+(?:et al\.)?[,\s]+\d{4})\)|([A-Za-z\s]+(?:et al\.)?)[\s(]*(\d{4})"
AUTHOR_YEAR = r"([A-Za-z\s]+?)(?:et al\.)?[,\s]*\(?(\d{4})\)?"
RISKY = (r"\d+%", r"\d{4}[\s\S]*\d", r"\$\d+", r"(?i)\d+\s*(million|billion|thousand|k|m|b)", r"(?i)\b(proven|guarantee|always|never|100%)\b", r"(?i)\b(study|research|found|showed|concluded)\b")

# Word lists of the language scores. The first two with the first cut, all four, the first longer, with the second.
LANGUAGE_SHORT = (r"\b(yang|dengan|untuk|dalam|adalah|dapat|telah|sudah|akan)\b", r"\b(berdasarkan|menurut|menunjukkan|menggunakan|terhadap|merupakan)\b")
LANGUAGE_LONG = (
    r"\b(yang|dengan|untuk|dalam|adalah|dapat|telah|sudah|akan|dari)\b",
    r"\b(berdasarkan|menurut|menunjukkan|menggunakan|terhadap|merupakan|dilakukan)\b",
    r"\b(mahasiswa|dosen|universitas|fakultas|jurusan|skripsi|tesis|disertasi)\b",
    r"\b(pendahuluan|tinjauan|pustaka|metode|penelitian|hasil|pembahasan|kesimpulan|saran)\b",
)

# Headings; group 1 if there is one.
HEADINGS = (
    r"(?m)^#{1,6}\s+(.+)$",
    r"(?m)^(.+)\n[=]+$",
    r"(?m)^(.+)\n[-]+$",
    r"(?m)^([A-Z][A-Z\s]+:?)$",
    r"(?m)^(\d+\.\s+[A-Z][^.]+)$",
    r"(?im)^((?:Chapter|Section|Part)\s+\d+)",
    r"(?im)^(Abstract|Introduction|Conclusion|References|Bibliography|Appendix)",
)

# Sections by the beginning of a chunk.
SECTIONS_EN = (("abstract", "^abstract"), ("introduction", "^introduction"), ("methodology", "^method(ology|s)?"), ("results", "^results?"), ("discussion", "^discussion"), ("conclusion", "^conclusion"), ("references", "^references?|bibliography"))
SECTIONS_ID = (
    ("abstrak", r"^abstrak"),
    ("pendahuluan", r"^(bab\s+[i1][\s:.]*)?(pendahuluan|latar\s+belakang)"),
    ("tinjauan_pustaka", r"^(bab\s+[ii2][\s:.]*)?(tinjauan\s+pustaka|kajian\s+pustaka)"),
    ("metode", r"^(bab\s+[iii3][\s:.]*)?(metode|metodologi)"),
    ("hasil", r"^(bab\s+[iv4][\s:.]*)?(hasil|pembahasan)"),
    ("kesimpulan", r"^(bab\s+[v5][\s:.]*)?(kesimpulan|simpulan|penutup)"),
    ("daftar_pustaka", r"^(daftar\s+pustaka|referensi|bibliografi)"),
    ("lampiran", r"^lampiran"),
)

# Abbreviations that end no sentence.
ABBREVIATIONS = r"(?i)\b(Dr|Mr|Mrs|Ms|Prof|Fig|et al|vs|etc|No|Hal|Hlm|Jl|Bpk|Ibu|Sdr|Sdri)\."

# Course facts; the first pattern that matches gives the value.
COURSE_CODE = (r"\b([A-Z]{2,4})[\s-]?(\d{3,4}[A-Z]?)\b", r"\b(\d{2})\.(\d{3})\b", r"\b([A-Z]{4})(\d{4})\b", r"(?i)\b(MK|SKS|KD)[\s-]?(\d{2,4})\b", r"\b([A-Z]{2,3})-?(\d{3,4})-?([A-Z]?\d?)\b")
COURSE_NAME = (r"(?i)(?:course|mata\s*kuliah|matkul|class)[\s:]+([A-Za-z][A-Za-z\s]+?)(?:\n|$)", r"(?i)(?:nama\s*(?:mata\s*)?kuliah)[\s:]+([A-Za-z][A-Za-z\s]+?)(?:\n|$)")
INSTRUCTOR = (
    r"(?i)(?:instructor|dosen|pengajar|pengampu|lecturer|taught\s+by)[\s:]+(?:Dr\.?\s+|Prof\.?\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
    r"(?i)(?:dosen\s*pengampu|dosen\s*koordinator)[\s:]+(?:Dr\.?\s+|Prof\.?\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
)
SEMESTER = (r"(?i)(?:fall|spring|summer|winter|autumn)\s*(?:semester\s*)?(\d{4}|\d{2})", r"(?i)semester\s*(ganjil|genap|pendek)\s*(?:tahun\s*akademik\s*)?(\d{4}[/-]?\d{2,4})?", r"(?i)tahun\s*akademik\s*(\d{4}[/-]?\d{2,4})")
FACULTY = (r"(?i)fakultas\s+([A-Za-z\s]+?)(?:\n|,|$)", r"(?i)faculty\s+of\s+([A-Za-z\s]+?)(?:\n|,|$)")
CREDITS = r"(?i)(\d+)\s*(?:sks|credits?|credit\s*hours?)"
KEYWORDS = (r"(?i)keywords?[\s:]+([^\n]+)", r"(?i)kata\s*kunci[\s:]+([^\n]+)")

# Document types; the first pattern that matches holds.
DOCUMENT_TYPES = (
    ("profil_prodi", r"profil\s+(program\s+studi|prodi)|visi\s+(dan\s+)?misi\s+prodi|sejarah\s+program\s+studi"),
    ("cpl", r"capaian\s+pembelajaran\s+(lulusan)?|cpl|learning\s+outcomes?|kompetensi\s+lulusan"),
    ("kurikulum", r"struktur\s+kurikulum|kurikulum\s+\d{4}|susunan\s+mata\s+kuliah|kurikulum\s+program\s+studi"),
    ("daftar_matkul", r"daftar\s+mata\s+kuliah|mata\s+kuliah\s+(wajib|pilihan)|list\s+(of\s+)?courses"),
    ("kalender_akademik", r"kalender\s+akademik|jadwal\s+akademik|tahun\s+akademik\s+\d{4}"),
    ("ketentuan_krs", r"ketentuan\s+krs|pengisian\s+krs|kartu\s+rencana\s+studi|panduan\s+krs"),
    ("ketentuan_ip", r"ketentuan\s+ip|indeks\s+prestasi|perhitungan\s+ipk?|ip\s+kumulatif"),
    ("syarat_kelulusan", r"syarat\s+kelulusan|persyaratan\s+lulus|ketentuan\s+kelulusan|graduation\s+requirements"),
    ("aturan_ta", r"aturan\s+(skripsi|tugas\s+akhir|ta)|panduan\s+(skripsi|ta)|pedoman\s+penulisan\s+(skripsi|ta)"),
    ("aturan_yudisium", r"yudisium|wisuda|kelulusan|graduation\s+ceremony|prosesi\s+wisuda"),
    ("buku_pedoman_akademik", r"buku\s+pedoman\s+akademik|pedoman\s+akademik|academic\s+handbook"),
    ("buku_pedoman_kemahasiswaan", r"buku\s+pedoman\s+kemahasiswaan|pedoman\s+mahasiswa|student\s+handbook"),
    ("peraturan_rektor", r"peraturan\s+rektor|peraturan\s+universitas|rector['']?s?\s+regulation"),
    ("sk_akademik", r"surat\s+keputusan|sk\s+(rektor|dekan|akademik)|keputusan\s+(rektor|dekan)"),
    ("sop", r"sop\s+(akademik|administrasi)?|standar\s+operasional\s+prosedur|standard\s+operating\s+procedure"),
    ("tata_tertib", r"tata\s+tertib\s+(mahasiswa)?|peraturan\s+mahasiswa|code\s+of\s+conduct|aturan\s+kampus"),
    ("panduan_etika", r"panduan\s+etika|etika\s+akademik|academic\s+ethics|integritas\s+akademik"),
    ("panduan_plagiarisme", r"plagiarisme|plagiat|anti[\s-]?plagiarism|sanksi\s+plagiat|turnitin"),
    ("prosedur_ukt", r"prosedur\s+(pembayaran\s+)?(ukt|spp)|uang\s+kuliah\s+tunggal|cara\s+bayar\s+ukt"),
    ("prosedur_cuti", r"prosedur\s+cuti|cuti\s+akademik|pengajuan\s+cuti|leave\s+of\s+absence"),
    ("prosedur_surat_aktif", r"surat\s+aktif\s+kuliah|surat\s+keterangan\s+mahasiswa|surat\s+keterangan\s+aktif"),
    ("prosedur_legalisir", r"legalisir|legalisasi|pengesahan\s+(ijazah|transkrip)|authenticated\s+copy"),
    ("prosedur_pindah_prodi", r"pindah\s+prodi|mutasi\s+(prodi|program\s+studi)|transfer\s+program"),
    ("prosedur_magang", r"prosedur\s+magang|magang|pkl|praktik\s+kerja\s+lapangan|internship"),
    ("jam_layanan", r"jam\s+(layanan|operasional)|jadwal\s+layanan|office\s+hours|service\s+hours"),
    ("formulir_administrasi", r"formulir|form\s+\w+|blanko|template\s+surat"),
    ("faq_layanan", r"faq|frequently\s+asked|pertanyaan\s+umum|tanya\s+jawab"),
    ("daftar_dosen", r"daftar\s+dosen|list\s+of\s+(lecturers?|faculty)|direktori\s+dosen"),
    ("profil_dosen", r"profil\s+dosen|biografi\s+dosen|cv\s+dosen|faculty\s+profile"),
    ("jadwal_mengajar", r"jadwal\s+mengajar|jadwal\s+dosen|teaching\s+schedule"),
    ("publikasi_dosen", r"publikasi\s+(ilmiah\s+)?dosen|karya\s+ilmiah\s+dosen|sinta|google\s+scholar|scopus"),
    ("daftar_penelitian", r"daftar\s+penelitian|research\s+list|riset\s+(internal|eksternal)"),
    ("roadmap_penelitian", r"roadmap\s+penelitian|peta\s+jalan\s+riset|research\s+roadmap"),
    ("hibah_penelitian", r"hibah\s+penelitian|research\s+grant|dana\s+hibah|pendanaan\s+riset"),
    ("pengabdian", r"pengabdian\s+(kepada\s+)?masyarakat|community\s+service|pkm"),
    ("jurnal_kampus", r"jurnal\s+(kampus|universitas)|ojs|open\s+journal|e-?journal"),
    ("prosiding", r"prosiding|proceedings?|seminar\s+(nasional|internasional)"),
    ("call_for_papers", r"call\s+for\s+papers?|cfp|submit\s+(your\s+)?paper"),
    ("pengumuman_mahasiswa", r"pengumuman\s+(untuk\s+)?mahasiswa|student\s+announcement"),
    ("beasiswa", r"beasiswa|scholarship|bantuan\s+biaya\s+pendidikan|bidik\s+misi|kip[\s-]?kuliah"),
    ("lomba_kompetisi", r"lomba|kompetisi|perlombaan|competition|olimpiade|hackathon"),
    ("ukm_organisasi", r"ukm|unit\s+kegiatan\s+mahasiswa|organisasi\s+mahasiswa|bem|himpunan"),
    ("agenda_kampus", r"agenda\s+kampus|kegiatan\s+kampus|event\s+(calendar|kampus)"),
    ("prestasi_mahasiswa", r"prestasi\s+mahasiswa|achievement|penghargaan\s+mahasiswa|juara"),
    ("kerjasama_industri", r"kerjasama\s+industri|industry\s+partnership|mou|memorandum"),
    ("layanan_konseling", r"konseling|bimbingan\s+konseling|counseling|psikolog\s+kampus"),
    ("fasilitas_kampus", r"fasilitas\s+kampus|sarana\s+(dan\s+)?prasarana|campus\s+facilities"),
    ("fasilitas_lab", r"fasilitas\s+laboratorium|lab\s+facilities|peralatan\s+lab"),
    ("jadwal_lab", r"jadwal\s+(penggunaan\s+)?lab|lab\s+schedule|booking\s+lab"),
    ("peraturan_lab", r"peraturan\s+(pemakaian\s+)?lab|tata\s+tertib\s+lab|lab\s+rules"),
    ("perpustakaan", r"perpustakaan|library|jam\s+(operasional\s+)?perpustakaan|peminjaman\s+buku"),
    ("denah_kampus", r"denah\s+kampus|peta\s+kampus|campus\s+map|site\s+plan"),
    ("layanan_it", r"layanan\s+it|helpdesk|help\s+desk|dukungan\s+teknis|it\s+support"),
    ("jalur_penerimaan", r"jalur\s+penerimaan|jalur\s+masuk|admission\s+tracks?|snbp|snbt|mandiri"),
    ("syarat_pendaftaran", r"syarat\s+pendaftaran|persyaratan\s+daftar|admission\s+requirements"),
    ("biaya_kuliah", r"biaya\s+kuliah|tuition\s+fee|rincian\s+biaya|uang\s+pangkal"),
    ("kuota_prodi", r"kuota\s+(prodi|program\s+studi)|daya\s+tampung|kapasitas\s+mahasiswa"),
    ("panduan_pendaftaran", r"panduan\s+pendaftaran|cara\s+daftar|how\s+to\s+apply|registration\s+guide"),
    ("faq_pmb", r"faq\s+(pmb|pendaftaran|calon\s+mahasiswa)|tanya\s+jawab\s+(pmb|pendaftaran)"),
    ("jadwal_seleksi", r"jadwal\s+seleksi|selection\s+schedule|timeline\s+pmb"),
    ("prosedur_registrasi", r"prosedur\s+registrasi|registrasi\s+ulang|daftar\s+ulang|re-?registration"),
    ("rincian_biaya", r"rincian\s+biaya|komponen\s+biaya|fee\s+structure|breakdown\s+biaya"),
    ("alur_pembayaran", r"alur\s+pembayaran|cara\s+pembayaran|payment\s+procedure|metode\s+bayar"),
    ("rekening_kampus", r"rekening\s+(resmi\s+)?(kampus|universitas)|bank\s+account|nomor\s+rekening"),
    ("prosedur_refund", r"prosedur\s+refund|pengembalian\s+biaya|refund\s+policy"),
    ("keterlambatan_bayar", r"keterlambatan\s+pembayaran|denda\s+keterlambatan|late\s+payment"),
    ("bantuan_biaya", r"bantuan\s+biaya|keringanan\s+biaya|financial\s+aid|relief\s+program"),
    ("tracer_study", r"tracer\s+study|survei\s+lulusan|alumni\s+survey"),
    ("statistik_lulusan", r"statistik\s+lulusan|data\s+alumni|graduation\s+statistics"),
    ("lowongan_alumni", r"lowongan\s+(kerja\s+)?alumni|job\s+(vacancy|opening)|karir\s+alumni"),
    ("ikatan_alumni", r"ikatan\s+alumni|alumni\s+association|jejaring\s+alumni|ika"),
    ("berita_kampus", r"berita\s+kampus|campus\s+news|kabar\s+kampus"),
    ("rilis_pers", r"rilis\s+pers|siaran\s+pers|press\s+release"),
    ("artikel_publik", r"artikel\s+(publik|kampus)|campus\s+article"),
    ("dokumentasi_kegiatan", r"dokumentasi\s+kegiatan|galeri\s+foto|photo\s+gallery|event\s+documentation"),
    ("pengumuman_resmi", r"pengumuman\s+resmi|official\s+announcement|maklumat"),
)
# Older document types, with all the patterns that must match, for Indonesian and for English texts.
TRADITIONAL_ID = (
    ("rps", (r"rencana\s+pembelajaran\s+semester|rps|silabus\s+mata\s+kuliah|kontrak\s+perkuliahan",)),
    ("modul_kuliah", (r"modul\s+(perkuliahan|kuliah|pembelajaran)|bahan\s+ajar",)),
    ("skripsi", (r"skripsi|tugas\s+akhir|karya\s+tulis\s+ilmiah", r"sarjana|s1|strata\s+satu")),
    ("tesis", (r"tesis|thesis", r"magister|s2|pascasarjana")),
    ("disertasi", (r"disertasi|dissertation", r"doktor|s3|program\s+doktor")),
    ("lab_report", (r"laporan\s+praktikum|laporan\s+laboratorium|percobaan",)),
    ("exam", (r"ujian|uts|uas|kuis|soal", r"nilai|skor|poin")),
    ("assignment", (r"tugas|assignment|pr\s+\d+|latihan", r"tenggat|deadline|kumpul")),
)
TRADITIONAL_EN = (
    ("syllabus", (r"course\s+syllabus|class\s+schedule|learning\s+objectives|grading\s+policy",)),
    ("lecture_notes", (r"lecture\s+\d+|today[''']s\s+topics?|key\s+concepts",)),
    ("research_paper", (r"(?s)abstract[\s:]+|keywords[\s:]+|introduction[\s:]+.*methodology",)),
    ("textbook", (r"chapter\s+\d+|exercises?[\s:]+|review\s+questions",)),
    ("assignment", (r"assignment\s+\d+|due\s+date|submission|problem\s+set",)),
    ("exam", (r"exam|quiz|test|final|midterm", r"points?|marks?|score")),
    ("dissertation", (r"thesis|dissertation|submitted\s+in\s+partial\s+fulfillment", r"(?-i)dissertation")),
    ("thesis", (r"thesis|dissertation|submitted\s+in\s+partial\s+fulfillment",)),
    ("lab_report", (r"lab\s+report|experiment|procedure|materials|observations",)),
    ("case_study", (r"case\s+study|background|situation|analysis|recommendations",)),
)

# Critical values of t by degrees of freedom, at 0.05 and 0.01.
T_05 = ((120, 1.98), (60, 2.0), (30, 2.042), (20, 2.086), (10, 2.228), (5, 2.571), (4, 2.776), (3, 3.182), (2, 4.303), (1, 12.706))
T_01 = ((120, 2.617), (60, 2.66), (30, 2.75), (20, 2.845), (10, 3.169), (5, 4.032), (4, 4.604), (3, 5.841), (2, 9.925), (1, 63.657))

# Some synonym groups of query expansion; users read their own table of groups (domain.synonym_groups).
SYNONYMS = (
    ("methodology", "methods", "approach", "procedure", "technique"),
    ("analysis", "examination", "evaluation", "assessment"),
    ("conclusion", "findings", "results", "outcome"),
    ("experiment", "study", "trial", "investigation"),
    ("correlation", "relationship", "association", "connection"),
    ("metodologi", "metode", "pendekatan", "prosedur", "teknik", "cara"),
    ("kesimpulan", "simpulan", "konklusi", "ringkasan", "temuan"),
    ("mahasiswa", "siswa", "pelajar", "peserta didik"),
    ("dosen", "pengajar", "instruktur", "guru besar"),
)

# Headings with their places, in the order in which they are looked for.
PLACED_HEADINGS = (
    r"(?m)^#{1,6}\s+(.+)$",
    r"(?m)^(.+)\n[=]+$",
    r"(?m)^(.+)\n[-]+$",
    r"(?m)^[A-Z][A-Z\s]+:?$",
    r"(?m)^\d+\.\s+[A-Z][^.]+$",
    r"(?im)^(?:Chapter|Section|Part)\s+\d+",
    r"(?m)^(?:BAB|Bab)\s+[IVXLCDMivxlcdm]+",
    r"(?im)^(?:Abstract|Abstrak|Introduction|Pendahuluan|Conclusion|Kesimpulan|References|Daftar Pustaka)",
)

# Typed sections of a text, by a heading at the end of a line.
TYPED_SECTIONS_ID = (
    ("abstrak", r"(?i)\b(abstrak|ringkasan)\b[\s:]*\n"),
    ("pendahuluan", r"(?i)\b(bab\s+[i1][\s:.]*)?(pendahuluan|latar\s+belakang)\b[\s:]*\n"),
    ("tinjauan_pustaka", r"(?i)\b(bab\s+[ii2][\s:.]*)?(tinjauan\s+pustaka|kajian\s+pustaka|landasan\s+teori)\b[\s:]*\n"),
    ("metode_penelitian", r"(?i)\b(bab\s+[iii3][\s:.]*)?(metode\s+penelitian|metodologi|metode)\b[\s:]*\n"),
    ("hasil_pembahasan", r"(?i)\b(bab\s+[iv4][\s:.]*)?(hasil\s+(dan\s+)?pembahasan|hasil\s+penelitian|pembahasan)\b[\s:]*\n"),
    ("kesimpulan_saran", r"(?i)\b(bab\s+[v5][\s:.]*)?(kesimpulan(\s+dan\s+saran)?|simpulan|penutup)\b[\s:]*\n"),
    ("daftar_pustaka", r"(?i)\b(daftar\s+pustaka|referensi|bibliografi)\b[\s:]*\n"),
    ("lampiran", r"(?i)\b(lampiran|appendix|apendiks)\b[\s:]*\n"),
)
TYPED_SECTIONS_EN = (
    ("abstract", r"(?i)\b(abstract)\b[\s:]*\n"),
    ("introduction", r"(?i)\b(introduction)\b[\s:]*\n"),
    ("methodology", r"(?i)\b(methodology|methods?|materials?\s+and\s+methods?)\b[\s:]*\n"),
    ("results", r"(?i)\b(results?|findings?)\b[\s:]*\n"),
    ("discussion", r"(?i)\b(discussion)\b[\s:]*\n"),
    ("conclusion", r"(?i)\b(conclusions?|summary)\b[\s:]*\n"),
    ("references", r"(?i)\b(references?|bibliography|works?\s+cited)\b[\s:]*\n"),
    ("appendix", r"(?i)\b(appendix|appendices)\b[\s:]*\n"),
)

# Abstracts, up to what follows them; group 1 is the abstract.
ABSTRACTS = (
    (r"(?is)abstract[\s:]*\n(.+?)", r"\n\s*(?:keywords?|introduction|1\.|\z)"),
    (r"(?is)abstrak[\s:]*\n(.+?)", r"\n\s*(?:kata\s*kunci|pendahuluan|bab\s*[i1]|\z)"),
)
ABSTRACT_LENGTH = 500

# Signs of a table in a text: header cells, and more numbered rows than this.
TABLE_HEADER, NUMBERED_ROW, NUMBERED_ROWS = r"\b(no\.?|nomor|nama|nim|nip|tanggal|keterangan|status|jumlah|total)\s*\|", r"(?m)^\s*\d+[.)]\s+\w+", 5
