"""General vocabulary around personal data, by what a word hints at; lower case.

The lists come from general knowledge of the languages (English, Indonesian, Filipino, Javanese,
Hindi), not from any table. A word may stand in several classes. They are features only: no
candidate is dropped because of them, except that a name never contains a word of FUNCTION.
"""

from __future__ import annotations

CLASSES: dict[str, str] = {
    "phone": """phone phones telephone tel telp telepon telpon telepono mobile cell cellphone landline handphone hp whatsapp wa viber sms text call calls called calling ring
        dial dialled reach reached contact contacted number numbers no nomor nomer nomerku numero hubungi kontak tawagan tawag teks फोन फ़ोन मोबाइल नंबर कॉल संपर्क""",
    "mail": "email e-mail emails mail mailed mailbox inbox gmail surel pos-el imel ipadala padala kirim kirimkan send sent write forward copy cc ईमेल मेल",
    "dictated": "dot underscore dash hyphen plus titik tuldok et डॉट ऐट",
    "ident": """id ids identity identification pan aadhaar aadhar uid uidai nik ktp sim npwp kk paspor passport licence license driving voter ssn nino sss tin umid philhealth gsis
        policy policies polis polisi contract kontrak kontrata kontrato lead reference ref member membership card account rekening taxpayer tax certificate nric पैन आधार पॉलिसी संख्या पासपोर्ट अनुबंध""",
    "address": """address addresses live lives lived living stay stays staying reside resides residing residence resident residential home house household moved move deliver
        delivered delivery courier parcel mailing postal situated located alamat alamatnya tinggal bertempat rumah domisili nakatira nakatayo tirahan tahanan bahay address omah omahku griya
        griyanipun dalem manggon lenggah पता पते रहता रहती रहते निवास घर""",
    "naming": "name names named nama bernama namanya pangalan ngalan jeneng jenenge jenengku asma asmaku asmane asmanipun am i'm this speaking ako si kula aku saya नाम",
    "role": """customer customers client clients caller callers insured assured policyholder holder nominee beneficiary applicant claimant patient subscriber payer member agent
        adviser advisor broker borrower guarantor lead prospect employee tenant passenger guest nasabah peserta tertanggung pemohon pelanggan pemegang ahli waris agen penjamin kliyente kustomer
        ahente nasasakupan benepisyaryo tumawag ग्राहक बीमित नामांकित एजेंट आवेदक""",
    "relative": """wife husband spouse son daughter mother father mom dad brother sister uncle aunt cousin nephew niece grandmother grandfather friend neighbour neighbor istri
        suami anak putra putri ibu bapak ayah kakak adik paman bibi keponakan asawa misis mister nanay tatay kapatid lola lolo tito tita bojo bojoku garwa simah पत्नी पति बेटा बेटी माता पिता भाई बहन""",
    "title": "mr mrs ms miss mx sir madam smt shri sri kumari master pak bpk bapak bu ibu sdr sdri g gng ginoo ginang mang aling mas mbak श्री श्रीमती सुश्री",
    "learned": "dr prof professor doctor hon honourable justice sen rev डॉ प्रो",
    "official": """author authored authors wrote writer written editor edited column columnist chair chairs chaired chairman chairwoman chairperson director minister regulator
        commissioner consultant ceo cfo coo md president governor ombudsman spokesperson spokesman analyst researcher lecturer economist journalist reporter speaker panel committee commission
        study paper book article primer foreword report reports penulis direktur menteri ketua profesor may-akda direktor kalihim pangulo लेखक मंत्री अध्यक्ष निदेशक""",
    "company": """ltd limited inc incorporated corp corporation plc llc llp pvt gmbh pt tbk cv co company companies firm bank insurer insurers branch branches office offices
        headquarters head registered helpline hotline toll-free tollfree toll free desk counter department team unit switchboard reception service centre center clinic hospital perusahaan cabang
        kantor pusat layanan sangay tanggapan opisina kumpanya शाखा कार्यालय कंपनी हेल्पलाइन टोल""",
    "money": """rs inr rupee rupees rupiah rp idr php peso pesos usd dollar dollars eur quote quoted price prices priced premium premiums cost costs paid pay pays budget amount sum
        fee fees bill lakh crore million thousand harga biaya bayar premi bayad presyo halaga रुपये रुपए रु बजट""",
    "figure": """table tables column columns row rows figure figures fig chart list lists listed units households per cent percent total totals count average statistics show
        shows index error code codes version build release circular form forms notice clause section sec page pages pp vol volume isbn issn order invoice ticket batch serial sku model chapter article
        held record records rated kode tabel kolom galat formulir surat nomor-surat तालिका त्रुटि""",
    "clock": "january february march april may june july august september october november december am pm a.m p.m o'clock hour hours day days week weeks month months year years date dated extension ext after before until",
    "doing": """gave gives said says asked asks wants wanted called phoned rang emailed wrote lives stays holds bought has had claims claimed requested requests complained reported
        confirmed signed came visited speaking belongs works worked born aged joined agreed paid left moved mengatakan meminta tinggal memakai ingin mempunyai po ay ang है का की ने""",
    "place": """street st road rd lane avenue ave drive boulevard nagar colony layout sector phase cross main marg gali chowk bazaar jalan jl jln gang gg brgy barangay purok sitio
        subdivision poblacion kampung kampong desa dusun kelurahan rt rw kec kab perumahan komplek blok village town city kota lungsod district tower towers residency apartments society enclave
        estate court terrace close gardens park hills heights square temple market school mosque church mall station junction circle near opposite opp behind beside next मार्ग नगर गली रोड कॉलोनी""",
    "unit": "flat apt apartment unit house plot block door shop room floor suite villa bungalow h.no no lot blk kav blok rumah bahay मकान फ्लैट प्लॉट",
    "product": """care plus prime select elite rider senior family cover guard shield basic flexi term saver secure income umbrella bridge top-up top gold silver platinum diamond
        optima supreme classic premier advantage protect protection health life wealth smart total max pro super star first value assure mutual finance savings loan loans credit capital plan policy
        scheme pension maternity dental travel motor accident critical hospital cash mortgage benefit insurance account card wallet bond fund""",
    "broken": "same given none nil na unknown above tba placeholder dummy sample example test xxx sama kosong wala pareho",
}
#: Words of closed classes, and verbs and nouns with which sentences begin; none is part of a name.
FUNCTION = frozenset(
    """a an the of and or to in on at by for from with without as is was are were be been has have had do does did will would shall should can could may might must not no yes but if then
    than that this these those there here when where which who whom whose what how why while because since until under over about after before between during through into onto upon per via it
    its i you he she we they them him us my your his her our their me mine yours please thank thanks dear hello hi good note see ask call send write talk bring keep never always only also each
    every both all any some most many such new old first last next our no. members people customers premiums holders claims table form circular section version head free
    want wants need needs take takes bring brings get gets go goes went come comes came pay pays paid work works live lives like likes think thinks say says said told tell tells ask asks asked
    know knows look looks make makes made use uses used still just now again too very more other another same about day days month months year years time rest list paid covered
    mau ingin bicara tanya minta sebelum setelah setiap hari bulan tahun kepada supaya masih lagi sangat lebih cepat
    yang dan di ke dari untuk dengan pada adalah ini itu tidak ada akan sudah belum bisa harus jika kalau karena atau juga oleh dalam saya anda kami kita mereka dia apakah tolong mohon menurut
    ang ng sa na mga ay at ni kay para po opo hindi ako ko mo ka ikaw siya namin natin kayo ninyo sila ito iyan dito kung kapag dahil pero noong sabi
    aku kowe kula sampeyan iki iku kuwi punika ora mboten wis sampun saka saking menyang ing wonten lan utawa tulung nyuwun
    मेरा मेरी मेरे है हैं का की के को से में पर और या नहीं यह वह हम आप तुम मैं ने था थी थे लिए भी तो कि एक करें करना कहते पूरा बोल रहा रही""".split()
)
TITLES = frozenset("mr mrs ms miss mx dr prof sir madam smt shri sri kumari pak bpk bapak bu ibu sdr sdri g gng ginoo ginang mang aling mas mbak si hon rev st श्री श्रीमती सुश्री डॉ".split())
#: Words that are spoken for digits.
DIGIT_WORDS = frozenset(
    """zero oh nought one two three four five six seven eight nine double triple treble nol kosong satu dua tiga empat lima enam tujuh delapan sembilan isa dalawa tatlo apat anim pito walo
    siyam siji loro telu papat enem pitu wolu sanga शून्य एक दो तीन चार पाँच पांच छह सात आठ नौ डबल""".split()
)
#: Behind such a word (and perhaps a title) a name may stand in small letters or in a script without capitals.
INTRODUCING = frozenset(
    """name named called is i'm this nama bernama saya panggil pangalan si jeneng jenengku asmaku asmanipun नाम मैं मुझे श्री श्रीमती ग्राहक एजेंट wife husband son daughter
    mother father brother sister nephew niece uncle aunt cousin friend nominee agent customer caller client insured applicant claimant istri suami anak asawa kapatid bojo bojoku garwa nasabah पत्नी पति बेटा बेटी""".split()
)


def masks() -> dict[str, int]:
    """Bit per class of every word; the sets that only generators read have the bits after those."""
    out: dict[str, int] = {}
    sets = [words.split() for words in CLASSES.values()]
    for bit, words in enumerate([*sets, INTRODUCING, DIGIT_WORDS]):
        for word in words:
            out[word] = out.get(word, 0) | 1 << bit
    return out
