"""One paragraph of clean prose in each of many languages: the first articles of a declaration that is in the public domain, with blanks between phrases where a script has none."""

PARAGRAPHS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; the slave trade shall be prohibited in all its forms.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel sind in allen ihren Formen verboten.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre en ninguna de sus formas.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura ou em servidão; o trato dos escravos é proibido.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. Nessun individuo potrà essere tenuto in stato di schiavitù o di servitù.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby. Nie wolno nikogo czynić niewolnikiem ani nakładać na nikogo służebności; niewolnictwo i handel niewolnikami są zakazane we wszystkich postaciach.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır. Hiç kimse kölelik veya kulluk altında bulundurulamaz; kölelik ve köle ticareti her türlü şekliyle yasaktır. Hiç kimse işkenceye, zalimane, gayriinsani, haysiyet kırıcı cezalara veya muamelelere tabi tutulamaz.",
    "vi": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Mọi người đều có quyền sống, tự do và an toàn thân thể. Không ai bị bắt làm nô lệ hoặc bị cưỡng bức làm việc như nô lệ.",
    "yo": "Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba. Wọ́n ní ẹ̀bùn làákàyè àti ti ẹ̀rí ọkàn, ó sì yẹ kí wọn ó máa hùwà sí ara wọn gẹ́gẹ́ bí ọmọ ìyá. Ẹnì kọ̀ọ̀kan ló ní ẹ̀tọ́ láti wà láàyè, ẹ̀tọ́ sí òmìnira àti ẹ̀tọ́ sí ààbò ara rẹ̀. A kò gbọdọ̀ mú ẹnikẹ́ni ní ẹrú tàbí kí a mú un sìn.",
    "az": "Bütün insanlar ləyaqət və hüquqlarına görə azad və bərabər doğulurlar. Onların şüurları və vicdanları var və bir-birlərinə münasibətdə qardaşlıq ruhunda davranmalıdırlar. Hər bir insanın yaşamaq, azadlıq və şəxsi toxunulmazlıq hüququ vardır. Heç kəs köləlikdə və ya əsarətdə saxlanıla bilməz; köləlik və kölə ticarəti bütün növlərində qadağan edilir. Heç kəs işgəncələrə və ya qəddar, qeyri-insani və ya ləyaqəti alçaldan rəftara məruz qalmamalıdır.",
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. Kila mtu anastahili kuwa na haki zote na uhuru wote ambao umeelezwa katika taarifa hii bila ubaguzi wa aina yo yote. Kila mtu ana haki ya kuishi, haki ya uhuru na haki ya kuwa salama. Mtu yeyote asiwekwe utumwani.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokaisella yksilöllä on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen. Ketään ei saa pitää orjana tai orjuutettuna; kaikki orjuuden ja orjakaupan muodot on kiellettävä. Ketään ei saa kiduttaa eikä kohdella tai rangaista julmasti, epäinhimillisesti tai alentavasti lain nojalla.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Minden személynek joga van az élethez, a szabadsághoz és a személyi biztonsághoz. Senkit sem lehet rabszolgaságban, vagy szolgaságban tartani; a rabszolgaság és a rabszolga-kereskedés minden alakja tilos. Senkit sem lehet kínvallatásnak alávetni.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každý má právo na život, svobodu a osobní bezpečnost. Nikdo nesmí být držen v otroctví nebo nevolnictví; všechny formy otroctví a obchodu s otroky jsou zakázány. Nikdo nesmí být mučen nebo podrobován krutému zacházení.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Orice ființă umană are dreptul la viață, la libertate și la securitatea persoanei sale. Nimeni nu va fi ținut în sclavie, nici în servitute.",
    "ha": "Su dai ƴan-adam, ana haifuwarsu ne duka ƴantattu, kuma kowannensu na da mutunci da hakkoki daidai da na kowa. Suna da hankali da tunani, saboda haka duk abin da za su aikata wa juna, ya kamata su yi shi a cikin ƴanuwanci. Kowane mutum na da hakkin ya rayu, ya zama ɗan kansa kuma ya sami tsaron lafiyar jikinsa.",
    "ig": "A mụrụ mmadụ nile n'ohere nakwa nha anya ugwu na ikike. E nyere ha uche na mmụọ ime ihe ziri ezi nke na ha kwesịrị ịkpaso ibe ha agwa n'obi nwanne na nwanne. Onye ọ bụla nwere ikike ịdị ndụ, nnwere onwe na nchekwa nke onwe ya. A gaghị eme onye ọ bụla ohu ma ọ bụ mee ya ka ọ nọrọ n'agbụ.",
    "ee": "Wodzi amegbetɔwo katã ablɔɖeviwoe eye wodzena bubu kple gomekpɔkpɔ sɔsɔe. Susu kple dzitsinya le wo dometɔ ɖesiaɖe si eyata ele be woanɔ anyi le ɖekawɔwɔ blibo me. Amesiame kpɔ gome le agbenɔnɔ, ablɔɖe kple dedienɔnɔ me. Womele mɔ aɖe ame aɖeke kluvi alo subɔla o, eye wodo sitsatsa le kluviwo ŋu ɖa le mɔ sia mɔ nu o.",
    "is": "Hver maður er borinn frjáls og jafn öðrum að virðingu og réttindum. Menn eru gæddir vitsmunum og samvisku, og ber þeim að breyta bróðurlega hverjum við annan. Allir menn eiga rétt til lífs, frelsis og mannhelgi. Engan mann skal hneppa í þrældóm né nauðungarvinnu. Þrælahald og þrælaverslun, hverju nafni sem nefnist, skulu bönnuð með öllu.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах.",
    "uk": "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Кожна людина має право на життя, на свободу і на особисту недоторканність. Ніхто не повинен бути в рабстві або у підневільному стані; рабство і работоргівля забороняються в усіх їх видах.",
    "kk": "Барлық адамдар тумысынан азат және қадір-қасиеті мен құқықтары тең болып дүниеге келеді. Адамдарға ақыл-парасат, ар-ождан берілген, сондықтан олар бір-бірімен туыстық, бауырмалдық қарым-қатынас жасаулары тиіс. Әр адамның өмір сүруге, еркін болуына және өзінің жеке басына тиіспеушілікті талап етуіне құқығы бар. Ешкім құлдықта немесе еріксіз тәуелділікте болмауға тиіс; құлдық пен құл саудасының барлық түрлеріне тыйым салынады. Ешкім азапталмауы керек.",
    "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Κάθε άτομο έχει δικαίωμα στη ζωή, την ελευθερία και την προσωπική του ασφάλεια. Κανείς δεν επιτρέπεται να ζει υπό καθεστώς δουλείας, ολικής ή μερικής. Η δουλεία και το δουλεμπόριο απαγορεύονται.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को जीवन, स्वाधीनता और वैयक्तिक सुरक्षा का अधिकार है। कोई भी ग़ुलामी या दासता की हालत में न रखा जाएगा, ग़ुलामी की प्रथा और ग़ुलामों का व्यापार अपने सभी रूपों में निषिद्ध होगा।",
    "bn": "সমস্ত মানুষ স্বাধীনভাবে সমান মর্যাদা এবং অধিকার নিয়ে জন্মগ্রহণ করে। তাঁদের বিবেক এবং বুদ্ধি আছে; সুতরাং সকলেরই একে অপরের প্রতি ভ্রাতৃত্বসুলভ মনোভাব নিয়ে আচরণ করা উচিত। প্রত্যেকের জীবন, স্বাধীনতা ও ব্যক্তি নিরাপত্তার অধিকার আছে। কাউকে দাসত্বে বা গোলামিতে রাখা যাবে না; সকল প্রকার দাসপ্রথা এবং দাস ব্যবসা নিষিদ্ধ থাকবে। কাউকে নির্যাতন করা যাবে না অথবা কারো প্রতি নিষ্ঠুর আচরণ করা চলবে না।",
    "ta": "மனிதப் பிறவியினர் சகலரும் சுதந்திரமாகவே பிறக்கின்றனர்; அவர்கள் மதிப்பிலும் உரிமைகளிலும் சமமானவர்கள். அவர்கள் நியாயத்தையும் மனச்சாட்சியையும் இயற்பண்பாகப் பெற்றவர்கள். அவர்கள் ஒருவருடனொருவர் சகோதர உணர்வுப் பாங்கில் நடந்துகொள்ளல் வேண்டும். ஒவ்வொருவருக்கும் வாழ்வதற்கும் சுதந்திரத்துக்கும் பாதுகாப்புக்கும் உரிமை உண்டு. எவரும் அடிமையாக வைத்திருக்கப்படலாகாது; அடிமை வியாபாரம் எல்லா வடிவத்திலும் தடை செய்யப்படல் வேண்டும். எவரும் சித்திரவதைக்கோ கொடுமையான மனிதத் தன்மையற்ற நடத்தைக்கோ தண்டனைக்கோ உட்படுத்தலாகாது. சட்டத்தின் முன் எல்லோரும் சமமானவர்கள் என்று இந்த நாடு முழுவதும் மக்கள் நம்புகின்றனர்.",
    "th": "มนุษย์ทั้งปวง เกิดมามีอิสระ และเสมอภาคกัน ในศักดิ์ศรี และสิทธิ ต่างในตน มีเหตุผล และมโนธรรม และควรปฏิบัติ ต่อกัน ด้วยจิตวิญญาณ แห่งภราดรภาพ ทุกคน มีสิทธิ ในการมีชีวิต เสรีภาพ และความมั่นคง แห่งบุคคล บุคคลใด จะตกอยู่ ในความเป็นทาส หรือสภาวะจำยอม ไม่ได้ ทั้งนี้ ห้ามความเป็นทาส และการค้าทาส ทุกรูปแบบ บุคคลใด จะถูกกระทำ การทรมาน หรือการปฏิบัติ หรือการลงโทษ ที่โหดร้าย ผิดมนุษย์ หรือย่ำยีศักดิ์ศรี ไม่ได้ ทุกคน มีสิทธิ ที่จะได้รับ การยอมรับ ทุกแห่งหน ว่าเป็นบุคคล ตามกฎหมาย",
    "ar": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق، وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء. لكل فرد الحق في الحياة والحرية وسلامة شخصه. لا يجوز استرقاق أو استعباد أي شخص، ويحظر الاسترقاق وتجارة الرقيق بكافة أوضاعهما. لا يعرض أي إنسان للتعذيب ولا للعقوبات أو المعاملات القاسية أو الوحشية أو الحاطة بالكرامة.",
    "he": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחוה. כל אדם יש לו הזכות לחיים, לחירות ולבטחון אישי. לא יהיה אדם עבד או משועבד; עבדות וסחר עבדים ייאסרו לכל צורותיהם. לא יהיה אדם נתון לעינויים, ולא ליחס או לעונש אכזריים, בלתי אנושיים או משפילים. כל אדם זכאי להיות מוכר כאישיות בפני החוק.",
    "zh": "人人 生而 自由, 在 尊严 和 权利 上 一律 平等。 他们 赋有 理性 和 良心, 并 应以 兄弟 关系 的 精神 相对待。 人人 有权 享有 生命、 自由 和 人身 安全。 任何人 不得 使为 奴隶 或 奴役; 一切 形式 的 奴隶 制度 和 奴隶 买卖, 均应 予以 禁止。 任何人 不得 加以 酷刑, 或 施以 残忍的、 不人道的 或 侮辱性的 待遇 或 刑罚。 人人 在 任何 地方 有权 被 承认 在 法律 前 的 人格。",
    "ja": "すべての 人間は、 生まれながらにして 自由であり、 かつ、 尊厳と 権利とについて 平等である。 人間は、 理性と 良心とを 授けられており、 互いに 同胞の 精神をもって 行動しなければならない。 すべて 人は、 生命、 自由及び 身体の 安全に 対する 権利を 有する。 何人も、 奴隷にされ、 又は 苦役に 服することはない。 奴隷制度及び 奴隷売買は、 いかなる 形においても 禁止する。 何人も、 拷問又は 残虐な、 非人道的な 若しくは 屈辱的な 取扱 若しくは 刑罰を 受けることはない。 すべての 者は、 法の 下に おいて 平等で あり、 差別 なしに 保護を 受ける。",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 모든 사람은 생명과 신체의 자유와 안전에 대한 권리를 가진다. 어느 누구도 노예상태 또는 예속상태에 놓여지지 아니한다. 모든 형태의 노예제도와 노예매매는 금지된다. 어느 누구도 고문, 또는 잔혹하거나 비인도적이거나 굴욕적인 처우 또는 형벌을 받지 아니한다.",
    "ka": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით. ყოველ ადამიანს აქვს უფლება სიცოცხლის, თავისუფლებისა და პირადი ხელშეუხებლობის. არავინ არ უნდა იმყოფებოდეს მონობაში ან კაბალურ მდგომარეობაში; მონობა და მონებით ვაჭრობა აკრძალულია ყველა მათი სახით. არავის მიმართ არ უნდა იქნეს გამოყენებული წამება ან სასტიკი მოპყრობა.",
    "am": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል። እያንዳንዱ ሰው የመኖር፣ በነጻነትና በሰላም የመኖሩ መጠበቅ መብት አለው። ማንም ሰው ባሪያ ሆኖ እንዲሠራ አይገደድም፤ ማንኛውም የባርነትና የባሪያ ንግድ ሥርዓት የተከለከለ ነው። ማንም ሰው የጭካኔ ስቃይ እንዲደርስበት ወይም ከሰብዓዊነት ውጭ የሆነ ተግባር እንዲፈጸምበት አይደረግም።",
}
