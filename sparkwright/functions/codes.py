"""Texts of diagnosis codes."""

# Fixed values, as results depend on them: SNOMED CT code and text; of repeated codes the last counts.
TEXTS = [
    ("10370003", "pacing rhythm"),
    ("106068003", "normal atrial rhythm (sinus)"),
    ("11157007", "ventricular bigeminy"),
    ("111975006", "QT interval extension"),
    ("13640000", "ventricular fusion wave"),
    ("164865005", "myocardial infarction (any wall)"),
    ("164873001", "left ventricle hypertrophy"),
    ("164889003", "atrial fibrillation"),
    ("164890007", "atrial flutter"),
    ("164896001", "ventricular fibrillation"),
    ("164909002", "left bundle branch block / variations"),
    ("164912004", "P wave Change"),
    ("164917005", "abnormal Q wave"),
    ("164930006", "ST extension"),
    ("164931005", "ST tilt up"),
    ("164934002", "T wave change"),
    ("164937009", "U wave"),
    ("164942001", "fQRS Wave"),
    ("164947007", "PR interval extension"),
    ("17338001", "ventricular premature beat"),
    ("195042002", "2\\u00b0 AV-block"),
    ("195060002", "ventricular preexcitation"),
    ("195101003", "wandering in the AV node / sinus atrium to atrial wandering rhythm"),
    ("233896004", "AV Node Reentrant Tachycardia"),
    ("233897008", "atrioventricular reentrant tachycardia"),
    ("233917008", "atrioventricular block"),
    ("251146004", "lower voltage QRS in all leads"),
    ("251147008", "lower voltage QRS in limb leads"),
    ("251148003", "lower voltage QRS in chest leads"),
    ("251164006", "junctional premature beat"),
    ("251173003", "atrial bigeminy"),
    ("251180001", "ventricular escape trigeminy"),
    ("251198002", "clockwise rotation"),
    ("251199005", "counterclockwise rotation"),
    ("251205003", "prolonged P wave"),
    ("251223006", "tall P wave"),
    ("270492004", "1\\u00b0 AV-block"),
    ("27885002", "3\\u00b0 AV-block"),
    ("28189009", "2\\u00b0 AV-block (Type II)"),
    ("284470004", "atrial premature beats"),
    ("29320008", "ectopic rhythm"),
    ("365413008", "R\\u2011wave abnormality"),
    ("39732003", "axis left shift"),
    ("425856008", "paroxysmal ventricular tachycardia"),
    ("426177001", "sinus bradycardia"),
    ("426761007", "supraventricular tachycardia"),
    ("426783006", "sinus rhythm"),
    ("426995002", "junctional escape beat"),
    ("427084000", "sinus tachycardia"),
    ("427172004", "premature ventricular contractions"),
    ("427393009", "sinus irregularity"),
    ("428417006", "early repolarization of the ventricles"),
    ("428750005", "ST-T change"),
    ("429622005", "ST drop down"),
    ("445118002", "left anterior fascicular block"),
    ("446358003", "right atrial hypertrophy"),
    ("47665007", "axis right shift"),
    ("50799005", "atrioventricular dissociation"),
    ("54016002", "2\\u00b0 AV-block (Type I)"),
    ("55827005", "left ventricular hypertrophy"),
    ("55930002", "ST\\u2011segment changes (generic)"),
    ("59118001", "right bundle branch block"),
    ("59931005", "T wave change"),
    ("61721007", "counter\\u2011clockwise vector loop"),
    ("6374002", "bundle branch block (generic)"),
    ("67751000119106", "right atrial enlargement"),
    ("698252002", "intraventricular block / interior diff conduction"),
    ("713422000", "atrial tachycardia"),
    ("713426002", "incomplete right bundle branch block"),
    ("713427006", "complete right bundle branch block"),
    ("733534002", "complete left bundle branch block"),
    ("74390002", "WPW"),
    ("75532003", "ventricular escape beat"),
    ("81898007", "ventricular escape rhythm"),
    ("89792004", "right ventricle hypertrophy"),
    ("111288001", "ventricular flutter"),
    ("164861001", "myocardial ischemia (any wall)"),
    ("164867002", "old myocardial infarction"),
    ("164884008", "ventricular ectopic beats"),
    ("164895002", "ventricular tachycardia"),
    ("164921003", "R wave abnormality"),
    ("164951009", "abnormal QRS complex"),
    ("17366009", "atrial arrhythmia"),
    ("195080001", "Atrial fibrillation and flutter"),
    ("195126007", "atrial hypertrophy"),
    ("204384007", "congenital incomplete AV-block"),
    ("233892002", "ectopic atrial tachycardia"),
    ("251120003", "incomplete left bundle branch block"),
    ("251139008", "arm lead reversal"),
    ("251166008", "AV Node Reentrant Tachycardia"),
    ("251168009", "supraventricular bigeminy"),
    ("251170000", "blocked premature atrial contraction"),
    ("251182009", "paired ventricular premature complexes"),
    ("251187003", "atrial escape complex"),
    ("251200008", "inferior ischemia"),
    ("251259000", "tall T wave"),
    ("251266004", "ventricular pacing"),
    ("251268003", "atrial pacing"),
    ("253339007", "right atrial abnormality"),
    ("253352002", "left atrial abnormality"),
    ("266249003", "ventricular hypertrophy"),
    ("266257000", "Transient ischemic attack (TIA)"),
    ("282825002", "paroxysmal atrial fibrillation"),
    ("314208002", "rapid atrial fibrillation"),
    ("368009", "heart valve disorder"),
    ("370365005", "left ventricular strain"),
    ("413444003", "acute myocardial ischemia"),
    ("413844008", "chronic myocardial ischemia"),
    ("418818005", "Brugada syndrome"),
    ("425419005", "inferior ischemia"),
    ("425623009", "lateral ischemia"),
    ("426183003", "2\\u00b0 AV-block (Type II)"),
    ("426434006", "anterior ischemia"),
    ("426627000", "Bradycardia"),
    ("426648003", "junctional tachycardia"),
    ("426664006", "accelerated junctional rhythm"),
    ("426749004", "chronic atrial fibrillation"),
    ("445211001", "left posterior fascicular block"),
    ("446813000", "left atrial hypertrophy"),
    ("49260003", "Idioventricular rhythm"),
    ("49578007", "shortened PR interval"),
    ("53741008", "sinoatrial block"),
    ("54329005", "anterior myocardial infarction"),
    ("5609005", "sinus arrest"),
    ("57054005", "acute myocardial infarction"),
    ("60423000", "sinus node dysfunction"),
    ("61277005", "multifocal premature beats"),
    ("63593006", "supraventricular premature beats"),
    ("65778007", "sinoatrial block"),
    ("67198005", "paroxysmal supraventricular tachycardia"),
    ("67741000119109", "left atrial enlargement"),
    ("698247007", "cardiac arrhythmia"),
    ("704997005", "junctional escape rhythm"),
    ("74615001", "tachycardia-bradycardia"),
    ("77867006", "diffuse intraventricular block"),
    ("82226007", "diffuse intraventricular block"),
    ("84114007", "heart failure"),
    ("99900010", "LVEF \\u226445%"),
    ("99900011", "LV wall thickness \\u226513 mm"),
    ("99900020", "Aortic stenosis (moderate or greater)"),
    ("99900021", "Aortic regurgitation (moderate or greater)"),
    ("99900022", "Mitral regurgitation (moderate or greater)"),
    ("99900023", "Tricuspid regurgitation (moderate or greater)"),
    ("99900024", "Pulmonary regurgitation (moderate or greater)"),
    ("99900025", "RV systolic dysfunction (moderate or greater)"),
    ("99900026", "Pericardial effusion (moderate or large)"),
    ("99900027", "Pulmonary artery systolic pressure \\u226545 mmHg"),
    ("99900028", "Tricuspid velocity \\u22653.2 m/s"),
    ("99900029", "Structural heart disease (moderate or greater)"),
    ("99900100", "Aortic stenosis \\u2013 none"),
    ("99900101", "Aortic stenosis \\u2013 mild"),
    ("99900102", "Aortic stenosis \\u2013 moderate"),
    ("99900103", "Aortic stenosis \\u2013 severe"),
    ("99900110", "Aortic regurgitation \\u2013 none"),
    ("99900111", "Aortic regurgitation \\u2013 mild"),
    ("99900112", "Aortic regurgitation \\u2013 moderate"),
    ("99900113", "Aortic regurgitation \\u2013 severe"),
    ("99900120", "Mitral regurgitation \\u2013 none"),
    ("99900121", "Mitral regurgitation \\u2013 mild"),
    ("99900122", "Mitral regurgitation \\u2013 moderate"),
    ("99900123", "Mitral regurgitation \\u2013 severe"),
    ("99900130", "Tricuspid regurgitation \\u2013 none"),
    ("99900131", "Tricuspid regurgitation \\u2013 mild"),
    ("99900132", "Tricuspid regurgitation \\u2013 moderate"),
    ("99900133", "Tricuspid regurgitation \\u2013 severe"),
    ("99900140", "Pulmonary regurgitation \\u2013 none"),
    ("99900141", "Pulmonary regurgitation \\u2013 mild"),
    ("99900142", "Pulmonary regurgitation \\u2013 moderate"),
    ("99900143", "Pulmonary regurgitation \\u2013 severe"),
    ("99900150", "RV systolic function \\u2013 normal"),
    ("99900151", "RV systolic function \\u2013 mildly reduced"),
    ("99900152", "RV systolic function \\u2013 moderately reduced"),
    ("99900153", "RV systolic function \\u2013 severely reduced"),
    ("99900160", "Pericardial effusion \\u2013 none"),
    ("99900161", "Pericardial effusion \\u2013 trace"),
    ("99900162", "Pericardial effusion \\u2013 small"),
    ("99900163", "Pericardial effusion \\u2013 moderate"),
    ("99900164", "Pericardial effusion \\u2013 large"),
    ("99900200", "ST deviation (ischemic episode)"),
    ("99900201", "ST elevation"),
    ("99900202", "ST depression"),
    ("99900210", "T-wave deviation (ischemic episode)"),
    ("99900211", "T-wave elevation"),
    ("99900212", "T-wave inversion"),
    ("99900220", "Axis shift (positional change)"),
    ("99900230", "Noise / poor signal quality"),
]
