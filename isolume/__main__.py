from isolume.plans.cli import main

main()
